"""URL filter: rules first, then a character language-model ratio.

1. Rules of host and path decide where one fits; the longest wins.
2. Two variable-order Markov models of characters are counted: one from accepted URLs (allowed by a rule, no seed
   term in the host), one from rejected ones (a seed term in the host).  Every labelled URL counts, as often as it occurs; texts in a fifth of
   all hashes are held out.  The domains and folders that the rules name and the top-level
   label are left out of the text the models see, of all URLs alike; all other labels and folders stay.
3. A sign is predicted from contexts of up to ``ORDER`` signs; a context seen ``SEEN`` times in a class speaks with the
   weight of Witten-Bell smoothing, shorter contexts fill in.  Copies of a text count in the shares of signs, but not in this weight: they
   are no further evidence for a context.  All strings of context and sign are kept with their
   log-likelihood difference, in a table that grows with the corpus.  A sign of a URL takes the entry of the longest context that has one.
4. A URL without a rule is blocked if its mean difference by sign is over the threshold, which is calibrated on
   held-out URLs: in the middle between the classes, but never so low that over ``FALSE_ALARMS`` of accepted ones are blocked.  For the
   threshold alone, differences are rounded up to ``GRID``.

Column algebra and joins only: texts are counted before they are taken apart, and scoring joins the distinct ends of distinct texts with
the table.  Sums are of whole numbers, so the order of rows doesn't change a score.

Edge cases: a NULL url or one without ``://`` has empty host and path, no rule, and an empty text, which is allowed;
repeated rows get equal verdicts; without URLs of one class all URLs without a rule are allowed; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tripleframe.llm.shared import stored

ORDER = 4
SEEN = 2
FALSE_ALARMS = 0.001
UNIT = 1 << 32  # parts of 1 in which differences are added up
GRID = 0.0001

# the rules of the contract: (host, path, allow)
RULES = (("net", "/", False), ("example.net", "/en/", True), ("example.com", "/de/", False), ("org", "/fr/", True))
# words that name rejected sites
SEEDS = ("spam", "casino", "pills", "adult", "bets", "ads-", "porn", "viagra", "gamble", "lottery")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or a domain above it and starts the path."""
    out = F.lit(None).cast("string")
    for domain, start, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        out = F.when(fits, domain + start).otherwise(out)
    return out


def _verdict_of(rule: Column, rules=RULES) -> Column:
    allowed = [d + p for d, p, allow in rules if allow]
    return F.when(rule.isin(allowed), "allow").when(rule.isNotNull(), "block")


def seen_text(host: Column, path: Column, rules=RULES) -> Column:
    """What the models see: the host without a rule's domain (or else the top-level label) at its end and the path without a rule's folder at
    its start, with ends marked.  Accepted URLs only have the top-level labels of rules, so that label would stand for the rules again."""
    domains, starts = ("|".join(re.escape(x) for x in sorted({r[k] for r in rules}) if x != "/") or "(?!)" for k in (0, 1))
    below = F.regexp_replace(host, rf"(?:^|\.)(?:{domains})$|(?<=.)\.[^.]+$", "")
    rest = F.regexp_replace(path, f"^(?:{starts})", "/")
    return F.when(host == "", "").otherwise(F.concat(F.lit("^"), F.regexp_replace(below, "[0-9]", "0"), F.lit(" "), F.regexp_replace(rest, "[0-9]", "0"), F.lit("$")))


def _grams(texts: DataFrame, k: int) -> DataFrame:
    """gram (a context of k signs and the next sign), rejected, accepted: counts by class, and ``own_`` both without copies of texts."""
    place = F.explode(F.when(F.length("t") > k, F.sequence(F.lit(k + 1), F.length("t"))))
    each = texts.select("reject", "n", F.col("t"), place.alias("i")).select("reject", "n", F.substring(F.col("t"), F.col("i") - k, F.lit(k + 1)).alias("gram"))
    count = lambda c, n: F.sum(F.when(c, n).otherwise(0))
    classes = {"rejected": F.col("reject"), "accepted": ~F.col("reject")}
    return each.groupBy("gram").agg(*[count(is_c, F.col("n")).alias(c) for c, is_c in classes.items()], *[count(is_c, 1).alias(f"own_{c}") for c, is_c in classes.items()])


def _models(texts: DataFrame) -> DataFrame:
    """gram, n, difference (log-likelihood as rejected less as accepted) of all strings up to ``ORDER`` + 1 signs; a text counts ``n`` times, or once."""
    texts = texts if "n" in texts.columns else texts.withColumn("n", F.lit(1))
    classes = ("rejected", "accepted")
    counts = _grams(texts, 0)
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in classes], F.count(F.lit(1)).alias("kinds")).first()
    last = stored(counts.select("gram", *classes, *[((F.col(c) + 1) / (total[c] + total["kinds"] + 1)).alias(f"p_{c}") for c in classes]), "grams")
    found = [last]
    for k in range(1, ORDER + 1):
        counts = _grams(texts, k).withColumn("context", F.substring("gram", 1, k))
        sums = [F.sum(c).alias(f"all_{c}") for c in classes] + [F.sum(f"own_{c}").alias(f"texts_{c}") for c in classes]
        seen = counts.groupBy("context").agg(*sums, *[F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(f"kinds_{c}") for c in classes])
        shorter = last.select(F.col("gram").alias("end"), *[F.col(f"p_{c}").alias(f"q_{c}") for c in classes])
        both = counts.join(seen, "context").withColumn("end", F.substring("gram", 2, k)).join(shorter, "end")

        def chance(c: str) -> Column:
            texts, kinds = F.col(f"texts_{c}"), F.col(f"kinds_{c}")
            own = (texts * (F.col(c) / F.col(f"all_{c}")) + kinds * F.col(f"q_{c}")) / (texts + kinds)
            return F.when(texts >= SEEN, own).otherwise(F.col(f"q_{c}")).alias(f"p_{c}")

        last = stored(both.select("gram", *classes, *[chance(c) for c in classes]), "grams")
        found.append(last)
    every = reduce(DataFrame.union, found)
    return every.select("gram", (F.col("rejected") + F.col("accepted")).alias("n"), (F.log("p_rejected") - F.log("p_accepted")).alias("difference"))


def _differences(texts: DataFrame, models: DataFrame) -> DataFrame:
    """t, d (mean log-likelihood difference by sign) of distinct texts; a text without any known sign is left out."""
    at = F.explode(F.when(F.length("t") > 1, F.sequence(F.lit(2), F.length("t"))))
    first = F.greatest(F.col("i") - ORDER, F.lit(1))
    ends = texts.select("t", at.alias("i")).select("t", F.substring(F.col("t"), first, F.col("i") - first + 1).alias("end"))
    parts = ends.select("end").distinct().select("end", F.explode(F.sequence(F.lit(1), F.length("end"))).alias("k"))
    parts = parts.select("end", "k", F.substring(F.col("end"), F.length("end") - F.col("k") + 1, F.col("k")).alias("gram"))
    known = models.select("gram", F.round(F.col("difference") * UNIT).cast("long").alias("value"))
    longest = stored(parts.join(known, "gram").groupBy("end").agg(F.max_by("value", "k").alias("value")), "url-ends")
    added = ends.join(longest, "end").groupBy("t").agg(F.sum("value").alias("sum"))
    return added.select("t", (F.col("sum") / UNIT / (F.length("t") - 1)).alias("d"))


def _threshold(held: DataFrame, scored: DataFrame) -> float:
    """From the held-out texts, each with its ``n`` rows; infinite, so that all is allowed, where a class has none."""
    on_grid = F.ceil(F.coalesce("d", F.lit(0.0)) / GRID) * GRID
    counts = held.join(scored, "t", "left").groupBy("reject", on_grid.alias("d")).agg(F.sum("n").alias("n"))
    of = lambda c, share: F.percentile(F.when(c, F.col("d")), F.lit(share), F.col("n"))
    reject = F.col("reject")
    facts = counts.agg(of(reject, 0.5).alias("bad"), of(~reject, 0.5).alias("good"), of(~reject, 1 - FALSE_ALARMS).alias("worst")).first()
    usable = facts["bad"] is not None and facts["good"] is not None
    # never below 0, where a text is as likely in both classes
    return max((facts["bad"] + facts["good"]) / 2, facts["worst"], 0.0) if usable else float("inf")


def judged(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, score (None where a rule decides) of every row."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    known = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = known.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("t", seen_text(F.col("host"), F.col("path"), rules))
    seed = F.col("host").rlike("|".join(map(re.escape, seeds)))
    labelled = known.where("t <> ''").withColumn("reject", seed).where(F.col("reject") | (_verdict_of(F.col("rule"), rules) == "allow"))
    texts = labelled.groupBy("reject", "t").agg(F.count(F.lit(1)).alias("n"))
    texts = stored(texts.withColumn("held", F.pmod(F.hash("t"), F.lit(5)) == 0), "url-texts")
    models = stored(_models(texts.where("NOT held")), "url-model")
    asked = known.where("rule IS NULL AND t <> ''").select("t").union(texts.where("held").select("t")).distinct()
    scored = stored(_differences(asked, models), "url-scores")
    threshold = _threshold(texts.where("held"), scored)
    score = F.when(F.col("rule").isNull(), F.coalesce("d", F.lit(0.0)))
    blocked = (F.col("score") > threshold) & (F.col("t") != "")
    verdict = F.coalesce(_verdict_of(F.col("rule"), rules), F.when(blocked, "block").otherwise("allow"))
    return known.join(scored, "t", "left").withColumn("score", score).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
