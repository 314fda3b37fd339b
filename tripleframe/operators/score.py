"""Scores of extracted triples against gold annotations.

Predictions are rows ``(run, doc_id, s, p, o)``, gold rows ``(doc_id, s, p, o)``, and the documents of a
run rows ``(run, doc_id)``.  Matching ignores case.  Copies of a triple are counted before anything is
shuffled or joined, so a document or triple that holds a large share of the rows stays spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEY = ["doc_id", "s", "p", "o"]


def _lower(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lower(c) for c in ("s", "p", "o")})


def join_gold(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Attach gold columns to predictions of the same document."""
    return pred.join(gold, "doc_id")


def zip_inner(left: DataFrame, right: DataFrame, on: str = "index") -> DataFrame:
    """Pair records of two lists by position; ends with the shorter list."""
    return left.join(right, on)


def _flag_matches(pred: DataFrame, gold: DataFrame) -> DataFrame:
    keys = _lower(gold).select(*KEY).distinct().withColumn("_hit", F.lit(True))
    lowered = pred.withColumns({f"_{c}": F.lower(c) for c in ("s", "p", "o")})
    keys = keys.withColumnsRenamed({c: f"_{c}" for c in ("s", "p", "o")})
    return (
        lowered.join(keys, ["doc_id", "_s", "_p", "_o"], "left")
        .withColumn("is_match", F.coalesce("_hit", F.lit(False)))
        .drop("_s", "_p", "_o", "_hit")
    )


def match_triples(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with ``is_match``: true positives and false positives, every copy for itself."""
    return _flag_matches(pred, gold)


def missed_triples(pred: DataFrame, gold: DataFrame, docs: DataFrame) -> DataFrame:
    """Gold triples a run never predicted, for every document of the run; every gold copy for itself."""
    seen = _lower(pred).select("run", *KEY).distinct()
    seen = seen.withColumnsRenamed({c: f"_{c}" for c in ("s", "p", "o")})
    wanted = docs.select("run", "doc_id").join(gold, "doc_id")
    wanted = wanted.withColumns({f"_{c}": F.lower(c) for c in ("s", "p", "o")})
    return wanted.join(seen, ["run", "doc_id", "_s", "_p", "_o"], "left_anti").drop("_s", "_p", "_o")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole, F.lit(0)))


def doc_scores(pred: DataFrame, gold: DataFrame, docs: DataFrame, distinct: bool = False) -> DataFrame:
    """Precision and recall of every document of every run.

    A document without a readable triple scores 0 and 0.  Each copy of a predicted triple counts, unless
    ``distinct``.  Predictions with a NULL part (it was no string) count as wrong.
    """
    copies = F.max(F.lit(1)) if distinct else F.count(F.lit(1))
    predicted = _lower(pred).groupBy("run", *KEY).agg(copies.cast("bigint").alias("n"))
    annotated = _lower(gold).groupBy(*KEY).agg(F.count(F.lit(1)).alias("g"))
    per_doc = (
        predicted.join(annotated, KEY, "left")
        .groupBy("run", "doc_id")
        .agg(
            F.sum("n").alias("n_pred"),
            F.sum(F.when(F.col("g").isNotNull(), F.col("n")).otherwise(0)).alias("tp"),
            F.coalesce(F.sum("g"), F.lit(0)).alias("covered"),
        )
    )
    # counted from the rows: the texts of the triples are not told apart again for it
    gold_size = gold.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_gold"))
    counts = (
        docs.select("run", "doc_id").join(per_doc, ["run", "doc_id"], "left").join(gold_size, "doc_id", "left")
        .na.fill(0, ["n_pred", "tp", "covered", "n_gold"])
    )
    tp, answered = F.col("tp"), F.col("n_pred") > 0
    fn = F.col("n_gold") - F.col("covered")
    return counts.select(
        "run", "doc_id", tp, (F.col("n_pred") - tp).alias("fp"), F.when(answered, fn).otherwise(F.col("n_gold")).alias("fn"),
        F.when(answered, _ratio(tp, F.col("n_pred"))).otherwise(0.0).alias("precision"),
        F.when(answered, _ratio(tp, tp + fn)).otherwise(0.0).alias("recall"),
    )


def run_scores(scores: DataFrame) -> DataFrame:
    """Macro precision and recall per run, the F1 of these two means, and the gold matches."""
    p, r = F.col("precision"), F.col("recall")
    return (
        scores.groupBy("run")
        .agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.sum("tp").alias("gold_matches"))
        .withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0))))
    )
