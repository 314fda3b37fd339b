"""Linking and knowledge-base checks against plain loops on a small random knowledge base."""

import random

import pytest

from tripleframe.operators import candidates, kb, linking

LABELS = [
    ("Q1", "item", "Paris", ["City of Light"], "capital", 90), ("Q2", "item", "Paris", [], "a town", 10),
    ("Q3", "item", "Parisian", None, "someone", 99), ("Q4", "item", "Light", ["Paris"], "a thing", 100),
    ("Q5", "item", "Oslo", [], None, 5), ("P1", "property", "capital of", [], "main city of", 7),
    ("P2", "property", "part of", ["piece of"], None, 3), ("Q6", "item", "city hall", [], "city hall of the city", 1),
]


def label_table(spark):
    return spark.createDataFrame(LABELS, "id string, kind string, label string, aliases array<string>, description string, popularity int")


def links(spark, values, kind="item"):
    df = spark.createDataFrame([(v,) for v in values], "label string")
    return {r.label: (r.id, r.match_class) for r in linking.link_labels(df, label_table(spark), kind).collect()}


def test_link_order(spark):
    got = links(spark, ["PARIS ", "city of light", "Pari", "os", "Nowhere", "", "O"])
    assert got == {
        "PARIS ": ("Q1", 1), "city of light": ("Q1", 2), "Pari": ("Q4", 3), "os": ("Q5", 3), "Nowhere": (None, None),
        "": (None, None), "O": ("Q5", 3),
    }


def test_function_words(spark):
    values = ["is part of", "is a is a part of", "was the capital of", "piece of", "can be the", "part"]
    df = spark.createDataFrame([(v,) for v in values], "label string")
    got = {r.label: (r.direct_id, r.stripped, r.id) for r in linking.link_predicates(df, label_table(spark)).collect()}
    assert got["is part of"] == (None, "part of", "P2")
    assert got["is a is a part of"] == (None, "part of", "P2")
    assert got["was the capital of"] == (None, "the capital of", None)
    assert got["piece of"] == ("P2", None, "P2")
    assert got["can be the"] == (None, "be the", None)
    assert got["part"] == ("P2", None, "P2")


def test_candidates(spark):
    df = spark.createDataFrame([("paris",), ("zzz",)], "label string")
    got = {r.label: r.candidates for r in candidates.candidates_by_string(df, label_table(spark), "item", 3).collect()}
    assert got == {"paris": ["Q1 (Paris): capital", "Q2 (Paris): a town", "Q4 (Light): a thing"], "zzz": None}
    df = spark.createDataFrame([("the City",), ("oslo town",), ("!!",)], "label string")
    got = {r.label: r.candidates for r in candidates.candidates_by_text(df, label_table(spark), "item", 3).collect()}
    assert got == {"the City": ["Q6 (city hall): city hall of the city"], "oslo town": None, "!!": None}
    none = candidates.no_candidates(candidates.candidates_by_string(df, label_table(spark)))
    assert {r.label for r in none.collect()} == {"the City", "oslo town", "!!"}


def random_kb(seed):
    rng = random.Random(seed)
    classes = [f"C{i}" for i in range(14)]
    up = {(a, "P279", b) for a, b in (sorted(rng.sample(classes, 2), key=lambda c: int(c[1:])) for _ in range(18))}
    inst = {(f"Q{i}", rng.choice(["P31", "P31", "P279"]), rng.choice(classes)) for i in range(1, 7) for _ in range(2)}
    facts = {(f"Q{rng.randint(1, 6)}", rng.choice(["P1", "P2"]), f"Q{rng.randint(1, 6)}") for _ in range(12)}
    limits = {(rng.choice(["P1", "P2"]), rng.choice(["domain", "range"]), rng.choice(classes)) for _ in range(5)}
    return up | inst | facts, limits


def plain_types(statements, item, first, full):
    up = {}
    for s, p, o in statements:
        if p == "P279":
            up.setdefault(s, set()).add(o)
    found = set()
    for s, p, c0 in statements:
        if s == item and p == first:
            paths = [[c0]]
            for _ in range(3):
                paths = [path + [n] for path in paths for n in (up.get(path[-1], ()) if path[-1] else ()) or ([] if full else [None])]
            for path in paths:
                found |= {(hop, c) for hop, c in enumerate(path) if c}
    return found


@pytest.mark.parametrize("seed,full", [(1, True), (2, False), (3, True)])
def test_types_and_checks(spark, seed, full):
    statements, limits = random_kb(seed)
    st = spark.createDataFrame(sorted(statements), "s string, p string, o string")
    con = spark.createDataFrame(sorted(limits), "property string, ctype string, class_id string")
    ids = [f"Q{i}" for i in range(1, 7)]
    idf = spark.createDataFrame([(i,) for i in ids], "id string")
    types = {i: plain_types(statements, i, "P31", full) | plain_types(statements, i, "P279", full) for i in ids}
    got = {}
    for r in kb.all_types(idf, st, full).collect():
        got.setdefault(r.id, set()).add((r.hop, r.class_id))
    assert got == {i: t for i, t in types.items() if t}

    # one entry per id, linked by its own name
    labels = [(i, "item", f"name {i}", [], "d", 1) for i in ids] + [("P1", "property", "rel one", [], "d", 1), ("P2", "property", "rel two", [], "d", 1)]
    lab = spark.createDataFrame(labels, "id string, kind string, label string, aliases array<string>, description string, popularity int")
    names = [f"name {i}" for i in ids] + ["unknown"]
    asked = [("r", n, k, s, p, o) for n, (s, p, o) in enumerate((s, p, o) for s in names for p in ("rel one", "is rel two", "zz") for o in names) for k in (0, 1)]
    triples = spark.createDataFrame(asked, "run string, doc_id int, pos int, s string, p string, o string")
    checked = kb.check_triples(triples, lab, st, con, full)
    rows = checked.collect()
    assert len(rows) == len(asked)
    by_name = {f"name {i}": i for i in ids}

    def lowest(item, prop, ctype):
        allowed = {c for q, t, c in limits if q == prop and t == ctype}
        hits = [hc for hc in types.get(item, ()) if hc[1] in allowed]
        return min(hits) if hits else None

    for r in rows:
        s, o = by_name.get(r.s), by_name.get(r.o)
        p = {"rel one": "P1", "is rel two": "P2"}.get(r.p)
        assert (r.s_id, r.p_id, r.o_id) == (s, p, o)
        assert r.p_direct_id == (p if r.p == "rel one" else None)
        linked = None not in (s, p, o)
        assert r.all_linked == linked
        d, g = (lowest(s, p, "domain") if s and p else None), (lowest(o, p, "range") if o and p else None)
        assert (r.domain_level, r.domain_class) == (d or (None, None))
        assert (r.range_level, r.range_class) == (g or (None, None))
        assert r.statement == ((s, p, o) in statements if linked else None)
        has = [any(q == p and t == c for q, t, _ in limits) for c in ("domain", "range")]
        assert [r.has_domain, r.has_range] == has
        assert r.has_both == (all(has) if p else None)
        assert r.object_missing == bool(p and all(has) and s and not o)
        match = bool(all(has) and d and g) if linked else None
        assert r.type_match == match
        assert r.level == (max(d[0], g[0]) if match else None)

    summary = kb.kb_summary(checked).first()
    assert summary.triples == len(asked)
    assert summary.hop_0 + summary.hop_1 + summary.hop_2 + summary.hop_3 == summary.domain_range_match
    assert summary.has_domain_range == summary.only_subject + summary.only_object + summary.neither + summary.both_linked
    assert summary.statement_and_match <= summary.statement <= summary.all_linked
    counted = kb.counted_triples(triples)
    weighed = counted.join(kb.check_distinct(counted.select("s", "p", "o").distinct(), lab, st, con, full), ["s", "p", "o"])
    assert kb.kb_summary(weighed).first() == summary
    last = kb.latest_by_triple(checked)
    assert last.count() == len(asked) // 2 and {r.pos for r in last.collect()} == {1}
    mentions = linking.distinct_mentions(checked)
    for r in linking.linking_stats(mentions).collect():
        assert r.linked + r.not_linked == r.all_mentions
    for r in kb.constraint_coverage(mentions, con).collect():
        assert r.with_both <= min(r.with_domain, r.with_range)


def test_descriptions(spark):
    ids = spark.createDataFrame([("Q5",), ("Q99",)], "id string")
    kept = {r.id: (r.label, r.description) for r in linking.describe_ids(ids, label_table(spark), keep_unknown=True).collect()}
    assert kept == {"Q5": ("Oslo", "No description available"), "Q99": ("No label available", "No description available")}
    assert linking.describe_ids(ids, label_table(spark)).count() == 1


def test_summary_with_malformed(spark):
    statements, limits = random_kb(4)
    counts = spark.createDataFrame([("r", 3)], "run string, malformed bigint")
    checked = kb.check_triples(
        spark.createDataFrame([("r", 1, 0, "a", "b", "c")], "run string, doc_id int, pos int, s string, p string, o string"),
        label_table(spark), spark.createDataFrame(sorted(statements), "s string, p string, o string"),
        spark.createDataFrame(sorted(limits), "property string, ctype string, class_id string"),
    )
    row = kb.kb_summary(checked, counts).first()
    assert (row.triples, row.malformed) == (4, 3)


def test_null_parts_keep_the_links_of_the_others(spark):
    label = spark.createDataFrame(
        [("Q1", "item", "a", None, "", 1), ("P1", "property", "p", None, "", 1)],
        "id string, kind string, label string, aliases array<string>, description string, popularity int",
    )
    statement = spark.createDataFrame([("Q1", "P1", "Q1")], "s string, p string, o string")
    constraint = spark.createDataFrame([("P1", "domain", "C", "class")], "property string, ctype string, class_id string, class_label string")
    triples = spark.createDataFrame([("r", "a", "p", None), ("r", None, "p", "a"), ("r", None, None, None)], "run string, s string, p string, o string")
    got = {(r["s"], r["p"], r["o"]): r for r in kb.check_triples(triples, label, statement, constraint).collect()}
    assert (got["a", "p", None]["s_id"], got["a", "p", None]["p_id"], got["a", "p", None]["o_id"]) == ("Q1", "P1", None)
    assert got["a", "p", None]["all_linked"] is False and got["a", "p", None]["has_domain"] is True
    assert got[None, "p", "a"]["o_id"] == "Q1" and got[None, None, None]["all_linked"] is False
    counted = kb.check_counted(triples, label, statement, constraint)
    assert counted.count() == 3 and counted.agg({"copies": "sum"}).first()[0] == 3


def test_many_parents_give_pairs_not_paths(spark):
    levels, width = 4, 20
    names = [[f"C{level}_{i}" for i in range(width)] for level in range(levels)]
    edges = [(a, "P279", b) for low, high in zip(names, names[1:]) for a in low for b in high] + [("x", "P31", names[0][0])]
    statement = spark.createDataFrame(edges, "s string, p string, o string")
    rows = kb.type_closure(spark.createDataFrame([("x",)], "id string"), statement).collect()
    want = {(0, names[0][0])} | {(n, c) for n in (1, 2, 3) for c in names[n]}
    assert {(r["hop"], r["class_id"]) for r in rows} == want and len(rows) == len(want)


def test_unrelated_classes_end_at_the_first_join(spark):
    from pyspark.sql import functions as F

    chain = spark.createDataFrame([("x", "P31", "C0"), *((f"C{i}", "P279", f"C{i + 1}") for i in range(4))], "s string, p string, o string")
    others = spark.range(1_000_000).select(F.concat(F.lit("U"), "id").alias("s"), F.lit("P279").alias("p"), F.concat(F.lit("U"), F.col("id") + 1).alias("o"))
    written = []
    real = kb.stored
    kb.stored = lambda df, name: written.append((name, real(df, name))) or written[-1][1]
    try:
        rows = kb.type_closure(spark.createDataFrame([("x",)], "id string"), chain.unionByName(others)).collect()
    finally:
        kb.stored = real
    assert {(r["hop"], r["class_id"]) for r in rows} == {(n, f"C{n}") for n in range(4)}
    assert [(name, df.count()) for name, df in written] == [("first-classes", 1), ("hop-1", 1), ("hop-2", 1), ("hop-3", 1)]
