"""Clusters against plain integer k-means."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tripleframe.llm import centroids as c


def plain(rows, k, rounds, parts, scale):
    """[(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)] with all distances computed anew."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == parts and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in order[:k]]

    def nearest(v):
        every = [sum((a - b) ** 2 for a, b in zip(v, m)) for m in centers]
        return every.index(min(every)), min(every)

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[0], []).append(v)
        for j, vs in members.items():
            centers[j] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = {}
    for _, j, d in found:
        total[j] = total.get(j, 0) + d
    return [(i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for i, j, d in found]


def made(n, parts, seed=5):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(i % 7, 1))) for _ in range(parts)]) for i in range(n)]


@pytest.mark.parametrize("n,k,parts,rounds", [(300, 16, 64, 3), (120, 5, 8, 4), (3, 16, 8, 3), (40, 1, 8, 0)])
def test_clusters_are_those_of_plain_rounds(spark, n, k, parts, rounds):
    rows = made(n, parts)
    odd = [(1000, None), (1001, []), (1002, [1.0] * (parts - 1)), (1003, [None] + [1.0] * (parts - 1)), (1004, [float("nan")] * parts), (1005, [float("-inf")] * parts)]
    rows += rows[:2] * 20 + [(None, [0.5] * parts), (None, rows[0][1]), (rows[0][0], [-0.01] * parts)]
    docs = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "'x' AS dots", "2 AS cluster").repartition(6)
    got = [tuple(r) for r in c.with_inertia(c.clusters(docs, k, rounds, parts)).collect()]
    want = plain(rows + odd, k, rounds, parts, 64)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_updates_touch_changed_components_only():
    rng = np.random.default_rng(0)
    vectors, before, change = (rng.integers(-2**26, 2**26, s) for s in ((200, 12), (4, 12), (4, 12)))
    change[:, 3:] = 0
    change[2] = 0
    dots = vectors @ before.T
    assert np.array_equal(c.updated(dots, vectors, change), vectors @ (before + change).T)
    # vectors that may not be read where nothing changes
    hidden = vectors.astype(object)
    hidden[:, 3:] = None
    assert np.array_equal(c.updated(dots.astype(object), hidden, change), vectors @ (before + change).T)


def test_equal_vectors_and_empty_clusters(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)]
    got = c.with_inertia(c.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 4, 3, 2)).collect()
    assert {tuple(r)[1:5] for r in got} == {(0, 0, 0, 0)} and len(got) == 50


def test_empty_table_and_large_components(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert c.with_inertia(c.clusters(empty)).count() == 0
    large = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(PySparkException, match="too large"):
        c.clusters(large, 2, 1, 2)
