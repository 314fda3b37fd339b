"""Hilbert places against the curve's definition, recall against brute force, awkward rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleframe.llm import ann

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_places_are_a_curve(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = ann.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def brute(rows, asks, k):
    """(query, id) lists: rows are (id, vector)."""
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 2 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if asks(q):
            near = sorted({(float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in good if i != q})[:k]
            out[q] = [(i, pytest.approx(d, abs=1e-12)) for d, i in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_copies_ties_and_bad_vectors(spark, block_rows):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 1.0]) for i in range(0, 60)] + [(100 + i, [math.cos(i), math.sin(i)]) for i in range(40)]
    rows += [(200 + i, [float(i % 3), float(i % 2)]) for i in range(20)] + [(300 + i, rng.normal(size=2).tolist()) for i in range(50)]
    rows += [(400, None), (410, [0.0, 0.0]), (420, [1.0, None]), (430, [float("nan"), 1.0]), (440, [1.0]), (450, []), (None, [1.0, 1.0]), (460, [float("inf"), 0.0]), (0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1)).repartition(3)
    got = found(ann.neighbours(df, F.col("vec_id") % 10 == 0, window=1.0, block_rows=block_rows))
    assert got == brute(rows, lambda q: q % 10 == 0, 10)


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert found(ann.neighbours(df, F.col("vec_id") == 0)) == {0: [(1, 0.0), (2, math.dist([1, 2], [3, 1]))]}
    assert ann.neighbours(df.limit(0), F.lit(True)).count() == 0
    assert ann.neighbours(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_recall_in_many_blocks(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    x = np.array([r["embedding"] for r in rows], float)
    ids = np.array([r["vec_id"] for r in rows])
    got = found(ann.neighbours(df, F.col("vec_id") % 20 == 0, block_rows=50))
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & {i for i, _ in got[ids[q]]})
    assert hits / (10 * len(got)) >= 0.9
