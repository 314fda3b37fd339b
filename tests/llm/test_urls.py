"""URL verdicts: rules against plain string handling, the models against counting by hand, awkward rows."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripleframe.llm import urls as u

URLS = [
    "https://a.example.net/en/1?x#y", "HTTP://A.Example.NET/de/1", "http://net/", "http://x.net", "http://x.net?/en/", "https://www.example.org/fr/2#t",
    "https://example.org/fr", "https://notexample.net/en/", "https://example.com/de/3", "https://b.example.com/en/4", "ftp://Ü.example.com/De/",
    "no scheme", "", None, "a://b://c/d", "http://evil-casino.example.com/en/5", "http://tionsh.example.com/en/5", "x" * 9000 + "://y.net/z", "http://",
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [d + p for d, p, _ in u.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


@pytest.fixture(scope="module")
def pages(spark):
    words = ["tion", "ther", "and", "ering", "blog", "thre"]
    hosts = [f"{a}{b}{n}.example.net/en/{n}" for a in words for b in words for n in range(3)]
    bad = [f"{a}-casino{n}.example.com/en/{n}" for a in words for n in range(8)]
    rows = [(i, x) for i, x in enumerate(URLS + [f"https://{h}" for h in hosts + bad])] + [(3, URLS[3]), (None, URLS[0])]
    return spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("score", F.lit(1)).repartition(3)


def test_hosts_paths_rules(pages):
    got = u.judged(pages).collect()
    want = pages.collect()
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted([(r["page_id"], r["host"], r["path"], r["rule"]) for r in got], key=key) == sorted([(r["page_id"], *plain(r["url"])) for r in want], key=key)
    allow = {d + p: a for d, p, a in u.RULES}
    for r in got:
        assert r["verdict"] in ("allow", "block")
        if r["rule"]:
            assert (r["verdict"] == "allow") == allow[r["rule"]]
        if not r["host"]:
            assert r["verdict"] == "allow"
    assert all(r["verdict"] == "block" for r in got if "casino" in r["host"])
    assert all(r["verdict"] == "allow" for r in got if r["host"] == "tionsh.example.com")


def test_models_are_those_counted_by_hand(spark):
    texts = [(False, x) for x in ("^tion $", "^tither $", "^tition /a$", "^ther $")] + [(True, x) for x in ("^casino $", "^ti-casino $", "^casino2 $")]
    df = spark.createDataFrame(texts, "reject boolean, t string")
    grams = {c: [Counter(t[i - k : i + 1] for r, t in texts if r == c for i in range(k, len(t))) for k in range(u.ORDER + 1)] for c in (True, False)}
    kinds = len(set(grams[True][0]) | set(grams[False][0]))

    def chance(c, gram):
        k, n = len(gram) - 1, grams[c]
        if k == 0:
            return (n[0][gram] + 1) / (sum(n[0].values()) + kinds + 1)
        after = {g: m for g, m in n[k].items() if g[:-1] == gram[:-1]}
        shorter = chance(c, gram[1:])
        if sum(after.values()) < u.SEEN:
            return shorter
        return (after.get(gram, 0) + len(after) * shorter) / (sum(after.values()) + len(after))

    known = [set(grams[True][k]) | set(grams[False][k]) for k in range(u.ORDER + 1)]

    def mean(t):
        total = 0.0
        for i in range(1, len(t)):
            held = [t[i - k : i + 1] for k in range(min(i, u.ORDER) + 1) if t[i - k : i + 1] in known[k]]
            total += math.log(chance(True, held[-1]) / chance(False, held[-1])) if held else 0
        return total / (len(t) - 1) if len(t) > 1 else 0

    probe = spark.createDataFrame([(t,) for _, t in texts] + [("^casion $",), ("",), ("^",), ("^zzz%$",)], "t string")
    scored = {r["t"]: r["d"] for r in u._differences(probe.distinct(), u._models(df)).collect()}
    for t in {r["t"] for r in probe.collect()}:
        assert scored.get(t, 0.0) == pytest.approx(mean(t), abs=1e-8), t
    held = spark.createDataFrame([(True, t, 3) for _, t in texts[:4]] + [(False, t, 2) for _, t in texts[-4:]], "reject boolean, t string, n long")
    assert u._threshold(held, u._differences(held.select("t").distinct(), u._models(df))) >= 0
    assert u._threshold(held.where("reject"), u._differences(probe, u._models(df))) == float("inf")


def test_one_class_or_no_rows(spark):
    some = spark.createDataFrame([(1, "http://casino.example.com/en/"), (2, "http://a.example.com/x/")], "page_id long, url string")
    assert {r["verdict"] for r in u.judged(some).collect()} == {"allow"}
    assert u.judged(some.limit(0)).count() == 0


def test_models_count_rows_and_keep_all_strings(spark, pages):
    score = lambda df: {r["host"]: r["score"] for r in u.judged(df).where("rule IS NULL").collect()}
    once = score(pages)
    again = pages.where("url LIKE '%casino%'").crossJoin(spark.range(20)).drop("id")
    assert score(pages.union(again)) != once
    assert score(pages.repartition(5)) == once


def test_models_see_all_but_the_parts_of_rules(spark):
    urls = ["http://casino-win.com/x", "http://a.example.net/en/1", "http://example.com/casino/2", "http://www.example.org/fr/3", "http://net/de", "http://pills.net/es/a"]
    df = spark.createDataFrame([(x,) for x in urls], "url string")
    seen = [r["t"] for r in df.select(u.seen_text(u.host_of(F.col("url")), u.path_of(F.col("url"))).alias("t")).collect()]
    assert seen == ["^casino-win /x$", "^a /0$", "^ /casino/0$", "^www.example /0$", "^ /de$", "^pills /es/a$"]


def test_registered_names_are_judged(spark):
    words = ["tion", "ther", "and", "ering", "blog", "thre", "garden", "music"]
    good = [f"http://{a}{b}.net/en/{a}" for a in words for b in words] + [f"http://www.{a}{b}.org/fr/{b}" for a in words for b in words]
    bad = [f"http://{a}-casino.com/{b}" for a in words for b in words]
    asked = ["http://tion-casin.com/and", "http://bloggarden.com/and"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(asked + [g.replace(".net/en/", ".example.net/en/") for g in good] + bad)], "page_id long, url string")
    got = {r["host"]: r["verdict"] for r in u.judged(df).where("page_id < 2").collect()}
    assert got == {"tion-casin.com": "block", "bloggarden.com": "allow"}
