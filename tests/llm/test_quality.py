"""Weak labels against plain counting and known accuracies; held-out accuracy; awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleframe.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_estimates_find_the_labellers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    miss = np.array([0.1, 0.3, 0.5, 0.6, 0.2])  # share of bad documents a labeller takes for good
    vote = np.where(good[:, None], 1, (rng.random((20_000, 5)) < miss).astype(int))
    vote[rng.random(vote.shape) < 0.2] = q.ABSTAIN
    codes = (vote * 3 ** np.arange(5)).sum(axis=1)
    patterns = dict(zip(*(x.tolist() for x in np.unique(codes, return_counts=True))))
    posterior, rate, share = q.estimate(patterns)
    assert abs(share - 0.8) < 0.02
    assert np.abs(rate[:, q.BAD, q.GOOD] - miss).max() < 0.05
    assert np.mean([(posterior[c] > 0.5) == g for c, g in zip(codes.tolist(), good)]) > 0.97


def test_features_are_shares():
    slots, values = q.features("One two, two THREE 4")
    assert len(slots) == 12 and abs(values[:-2].sum() - 2) < 1e-9
    assert q.features(None)[0].size == 0 and q.score("", np.zeros(q.DIMENSIONS + 1)) == 0


def test_word_facts_do_not_depend_on_the_cache():
    text = "Ab ab. AB!! x### 12 中文 Éa ... don't"
    before = q.votes(text), q.features(text)[0].tolist()
    q._FACTS.clear()
    q._SLOTS.clear()
    assert (q.votes(text), q.features(text)[0].tolist()) == before


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_accuracy(spark, docs):
    found = q.scored(docs, sample=400).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    wrong_bad, wrong_good, n = found.agg(
        F.sum(((F.col("quality") == 1) & ~F.col("keep")).cast("int")), F.sum(((F.col("quality") == 0) & F.col("keep")).cast("int")), F.count("*")
    ).first()
    assert wrong_bad == 0 and wrong_good <= 0.02 * n


def test_scores_are_those_of_one_process(docs):
    weights = q.train(docs, 300)
    got = {r["doc_id"]: r["score"] for r in docs.select("doc_id", q.scorer(weights).alias("score")).collect()}
    for r in docs.limit(50).collect():
        assert got[r["doc_id"]] == pytest.approx(q.score(r["text"], weights.astype(np.float32)))


def test_awkward_rows(spark, docs):
    odd = spark.createDataFrame([(None, "A fine text, with words."), (-1, None), (-2, ""), (-3, " \n "), (-4, "word " * 50_000), (-4, "word " * 50_000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(odd).withColumn("score", F.lit("clash"))
    kept = q.accepted(both, 300)
    assert kept.columns == both.columns
    assert kept.where("doc_id < 0").count() == 0 and kept.where("doc_id IS NULL").count() == 1
    scores = q.scored(both, 300)
    assert scores.count() == both.count() and {r["score"] for r in scores.where("doc_id IN (-1, -2, -3)").collect()} == {0.0}
    assert q.accepted(both.limit(0)).count() == 0
