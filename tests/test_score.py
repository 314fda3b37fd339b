"""Scores against a plain loop over random triples."""

import random
from collections import defaultdict

from tripleframe.operators import score

T = "run string, doc_id int, s string, p string, o string"


def make(rng, n, runs=("a", "b")):
    return [(rng.choice(runs), rng.randrange(12), rng.choice("xyX"), rng.choice("pq"), rng.choice("mnN")) for _ in range(n)]


def plain(pred, gold, docs):
    out = {}
    low = lambda t: tuple(x.lower() for x in t)
    for run, doc in docs:
        found = [low(t[2:]) for t in pred if t[:2] == (run, doc)]
        true = [low(t[1:]) for t in gold if t[0] == doc]
        tp = sum(t in true for t in found)
        fn = sum(t not in found for t in true)
        p = tp / len(found) if found else 0
        r = tp / (tp + fn) if found and tp + fn else 0
        out[run, doc] = (round(p, 9), round(r, 9), tp)
    return out


def test_random_documents(spark):
    rng = random.Random(5)
    pred, gold = make(rng, 60), [t[1:] for t in make(rng, 50)]
    docs = [(r, d) for r in "ab" for d in range(14)]
    frames = (
        spark.createDataFrame(pred, T), spark.createDataFrame(gold, T.replace("run string, ", "")),
        spark.createDataFrame(docs, "run string, doc_id int"),
    )
    scores = score.doc_scores(*frames)
    got = {(r.run, r.doc_id): (round(r.precision, 9), round(r.recall, 9), r.tp) for r in scores.collect()}
    expected = plain(pred, gold, docs)
    assert got == expected
    by_run = defaultdict(list)
    for (run, _), v in expected.items():
        by_run[run].append(v)
    for row in score.run_scores(scores).collect():
        v = by_run[row.run]
        p, r = sum(x[0] for x in v) / len(v), sum(x[1] for x in v) / len(v)
        assert abs(row.precision - p) < 1e-8 and abs(row.recall - r) < 1e-8
        assert abs(row.f1 - 2 * row.precision * row.recall / (row.precision + row.recall)) < 1e-12
        assert row.gold_matches == sum(x[2] for x in v)
    matched = score.match_triples(frames[0], frames[1]).where("is_match").count()
    assert matched == sum(x[2] for x in expected.values())


def test_edges(spark):
    gold = spark.createDataFrame([(1, "a", "b", "c")], "doc_id int, s string, p string, o string")
    pred = spark.createDataFrame([("r", 1, "A", "B", "C"), ("r", 1, "a", "b", "c"), ("r", 1, "a", None, "c"), ("r", 2, "x", "y", "z")], T)
    docs = spark.createDataFrame([("r", 1), ("r", 2), ("r", 3)], "run string, doc_id int")
    got = {r.doc_id: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in score.doc_scores(pred, gold, docs).collect()}
    assert got == {1: (2, 1, 0, 2 / 3, 1.0), 2: (0, 1, 0, 0.0, 0.0), 3: (0, 0, 0, 0.0, 0.0)}
    once = {r.doc_id: r.tp for r in score.doc_scores(pred, gold, docs, distinct=True).collect()}
    assert once[1] == 1
    assert score.run_scores(score.doc_scores(pred, gold, docs).where("false")).count() == 0
    assert [r.doc_id for r in score.missed_triples(pred.where("doc_id = 2"), gold, docs).collect()] == [1]


def test_gold_triples_are_told_apart_once(spark):
    import re

    pred = spark.createDataFrame([("r", 1, "A", "p", "b"), ("r", 1, "x", "p", None)], "run string, doc_id int, s string, p string, o string")
    gold = spark.createDataFrame([(1, "a", "P", "B"), (1, "a", "P", "B"), (1, "n", None, "o"), (2, "a", "p", "b")], "doc_id int, s string, p string, o string")
    docs = spark.createDataFrame([("r", 1), ("r", 2), ("r", 3)], "run string, doc_id int")
    scores = score.doc_scores(pred, gold, docs)
    assert {r.doc_id: (r.tp, r.fp, r.fn) for r in scores.collect()} == {1: (1, 1, 1), 2: (0, 0, 1), 3: (0, 0, 0)}
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[doc_id#\d+, s#\d+", plan)) == 1
