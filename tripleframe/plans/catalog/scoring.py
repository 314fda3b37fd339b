"""Queries of scores against gold annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleframe.operators import extract, score
from tripleframe.plans.catalog.registry import Registry
from tripleframe.plans.ranking import global_rank, seeded_hash

R = Registry()
QUERIES, SQL = R.queries, R.sql

# Shared by the score statements: matches per document, with every copy counted.
_SCORED = """
WITH g AS (SELECT doc_id, lower(s) AS s, lower(p) AS p, lower(o) AS o FROM fx_gold),
 pr AS (SELECT run, doc_id, lower(s) AS s, lower(p) AS p, lower(o) AS o FROM fx_pred),
 hit AS (SELECT run, doc_id, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM g WHERE g.doc_id = pr.doc_id
   AND g.s = pr.s AND g.p = pr.p AND g.o = pr.o)) AS tp FROM pr GROUP BY run, doc_id),
 miss AS (SELECT d.run, d.doc_id, count(*) AS fn FROM fx_docs d JOIN g ON g.doc_id = d.doc_id WHERE NOT EXISTS (
   SELECT 1 FROM pr WHERE pr.run = d.run AND pr.doc_id = d.doc_id AND g.s = pr.s AND g.p = pr.p AND g.o = pr.o)
   GROUP BY d.run, d.doc_id),
 per_doc AS (SELECT d.run, d.doc_id, coalesce(tp, 0) AS tp, coalesce(n, 0) - coalesce(tp, 0) AS fp, coalesce(fn, 0) AS fn,
   CASE WHEN coalesce(n, 0) = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / n END AS "precision",
   CASE WHEN coalesce(n, 0) = 0 OR tp + coalesce(fn, 0) = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + coalesce(fn, 0)) END AS recall
   FROM fx_docs d LEFT JOIN hit USING (run, doc_id) LEFT JOIN miss USING (run, doc_id))
"""


def _scores(spark):
    return score.doc_scores(spark.table("fx_pred"), spark.table("fx_gold"), spark.table("fx_docs"))


@R.add(
    "doc_scores",
    _SCORED + 'SELECT run, doc_id, tp, fp, fn, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM per_doc',
    "fx_pred fx_gold fx_docs",
)
def doc_scores(spark):
    """Precision and recall of every document of every run."""
    return _scores(spark).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@R.add(
    "run_scores",
    _SCORED
    + """, m AS (SELECT run, avg("precision") AS p, avg(recall) AS r, sum(tp)::BIGINT AS gold_matches FROM per_doc GROUP BY run)
SELECT run, round(p, 6) AS "precision", round(r, 6) AS recall, gold_matches,
  round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM m""",
    "fx_pred fx_gold fx_docs",
)
def run_scores(spark):
    """Macro precision, recall and F1 of every run."""
    return score.run_scores(_scores(spark)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@R.add(
    "extracted_scores",
    _SCORED.replace("FROM fx_pred)", "FROM fx_pred WHERE doc_id % 16 <> 11)")  # the prose format holds no triples
    + """, m AS (SELECT run, avg("precision") AS p, avg(recall) AS r, sum(tp)::BIGINT AS gold_matches FROM per_doc GROUP BY run)
SELECT run, round(p, 6) AS "precision", round(r, 6) AS recall, gold_matches,
  round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM m""",
    "fx_pred fx_gold fx_docs",
)
def extracted_scores(spark):
    """From generated texts to macro precision, recall and F1 of every run."""
    triples = extract.canonical_triples(extract.extract_triples(spark.table("fx_generated"), "text"))
    matchable = triples.withColumn("o", F.when(F.col("matchable"), F.col("o")))
    scores = score.doc_scores(matchable, spark.table("fx_gold"), spark.table("fx_docs"))
    return score.run_scores(scores).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@R.add(
    "doc_scores_distinct",
    _SCORED.replace("FROM fx_pred)", "FROM fx_pred GROUP BY ALL)")
    + 'SELECT run, doc_id, tp, fp, fn, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM per_doc',
    "fx_pred fx_gold fx_docs",
)
def doc_scores_distinct(spark):
    """As doc_scores, with copies of a prediction counted once."""
    found = score.doc_scores(spark.table("fx_pred"), spark.table("fx_gold"), spark.table("fx_docs"), distinct=True)
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@R.add(
    "matched",
    """SELECT run, doc_id, pos, s, p, o, EXISTS (SELECT 1 FROM fx_gold g WHERE g.doc_id = q.doc_id AND lower(g.s) = lower(q.s)
  AND lower(g.p) = lower(q.p) AND lower(g.o) = lower(q.o)) AS is_match FROM fx_pred q""",
    "fx_pred fx_gold",
)
def matched(spark):
    """Every prediction with the flag whether the gold annotation holds it."""
    return score.match_triples(spark.table("fx_pred"), spark.table("fx_gold"))


@R.add(
    "missed",
    """SELECT d.run, d.doc_id, g.pos, g.s, g.p, g.o FROM fx_docs d JOIN fx_gold g ON g.doc_id = d.doc_id
WHERE NOT EXISTS (SELECT 1 FROM fx_pred q WHERE q.run = d.run AND q.doc_id = d.doc_id AND lower(g.s) = lower(q.s)
  AND lower(g.p) = lower(q.p) AND lower(g.o) = lower(q.o))""",
    "fx_pred fx_gold fx_docs",
)
def missed(spark):
    """Gold triples a run never predicted."""
    return score.missed_triples(spark.table("fx_pred"), spark.table("fx_gold"), spark.table("fx_docs"))


@R.add(
    "join_gold",
    """SELECT g.run, g.doc_id, g.text AS generated_text, d.text FROM fx_generated g JOIN fx_doc_text d ON g.doc_id = d.doc_id""",
    "fx_generated fx_doc_text",
)
def join_gold(spark):
    """Generations with the text they were made from."""
    generated = spark.table("fx_generated").withColumnRenamed("text", "generated_text")
    return score.join_gold(generated, spark.table("fx_corpus").select("doc_id", "text"))


@R.add(
    "zip_inner",
    """WITH c AS (SELECT text, row_number() OVER (ORDER BY md5('13:' || conv_id || '/' || turn), conv_id, turn) AS n FROM conversations),
 d AS (SELECT text, row_number() OVER (ORDER BY md5('13:' || doc_id), doc_id) AS n FROM documents)
SELECT c.n AS index, c.text AS generated_text, d.text FROM c JOIN d ON d.n = c.n""",
)
def zip_inner(spark):
    """Two shuffled lists paired by position."""
    def listed(table, key, keys):
        hashed = spark.table(table).withColumn("_hash", seeded_hash(13, key))
        return global_rank(hashed, "_hash", keys, "index")

    generated = listed("conversations", F.concat_ws("/", "conv_id", "turn"), ["conv_id", "turn"]).select(
        "index", F.col("text").alias("generated_text")
    )
    documents = listed("documents", F.col("doc_id"), ["doc_id"]).select("index", "text")
    return score.zip_inner(generated, documents)
