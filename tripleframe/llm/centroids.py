"""k-means on integer vectors with an incremental distance matrix.

1. Components become integers, ``floor(scale * x)``.  The ``k`` vectors whose id has the smallest seeded hash are the
   first centroids.
2. Every vector keeps its row of the distance matrix in a written table: its squared length and its exact integer
   dot product with every centroid.
3. A round assigns each vector to the centroid with the smallest squared distance, read off that row (squared length -
   2 * product + squared length of the centroid), and adds up members per cluster: in numpy within a task, so
   that a task sends at most ``k`` rows, then in Spark.  Non-empty centroids move to the exact floor of the mean.
4. The products are then updated, not computed again: for each centroid only the components that changed enter,
   times their change.  The new table is written and the next round reads it, so a lost executor repeats
   its share of one round.  The driver holds ``k`` centroids, nothing else.

Ties in distance go to the smaller centroid number, ties in the hash to the smaller vector.  Edge cases: vectors that are
NULL, of another length, or hold NULL or non-finite components take no part; an id may repeat or be NULL, each row is
a vector of its own (a NULL id comes last among the first centroids); fewer vectors than ``k`` make fewer clusters;
an empty table gives no rows; other columns are not read.  Integers beyond +-2**26 raise an error, since
their distances would not be exact in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tripleframe.llm.shared import stored

CLUSTERS, ROUNDS, PARTS, SCALE = 16, 3, 64, 64
LARGEST = 1 << 26


class Clustering(NamedTuple):
    """Rows vec_id, cluster, distance (squared) and the final centroids."""

    assigned: DataFrame
    centroids: np.ndarray


def integers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (array<int>) of the vectors with ``parts`` finite components."""
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    kept = kept.where((F.size("x") == parts) & F.coalesce(finite, F.lit(False)))
    whole = lambda x: F.floor(x * float(scale))
    safe = lambda x: F.when(F.abs(x * float(scale)) <= LARGEST, whole(x)).otherwise(F.raise_error(F.lit("component too large for exact distances")).cast("bigint"))
    return kept.select("vec_id", F.transform("x", lambda x: safe(x).cast("int")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), kind))


def distances(lengths: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return lengths[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)[None, :]


def updated(dots: np.ndarray, vectors: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The products after every centroid changed by its row of ``change``; components that stay are not touched."""
    dots = dots.copy()
    for j, row in enumerate(change):
        moved = np.flatnonzero(row)
        if len(moved):
            dots[:, j] += vectors[:, moved] @ row[moved]
    return dots


def _with_products(state: DataFrame, change: np.ndarray) -> DataFrame:
    """The written table vec_id, v, length, dots after the change; a table without dots starts from zero."""
    k, parts = change.shape
    fresh = "dots" not in state.columns

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1), parts)
            if fresh:
                lengths, dots = pa.array((vectors * vectors).sum(axis=1)), np.zeros((len(vectors), k), np.int64)
            else:
                lengths, dots = batch.column(2), _matrix(batch.column(3), k)
            columns = [batch.column(0), batch.column(1), lengths, _lists(updated(dots, vectors, change), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "length", "dots"])

    return stored(state.mapInArrow(update, "vec_id long, v array<int>, length long, dots array<long>"), "products")


def _member_sums(state: DataFrame, centroids: np.ndarray) -> list:
    """Rows (cluster, n, sums) of the clusters that have members."""
    k, parts = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, parts), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0), parts)
            nearest = distances(batch.column(1).to_numpy(), _matrix(batch.column(2), k), centroids).argmin(axis=1)
            n += np.bincount(nearest, minlength=k)
            for j in range(k):
                sums[j] += vectors[nearest == j].sum(axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used]), _lists(sums[used], pa.int64())], ["cluster", "n", "sums"])

    partial = state.select("v", "length", "dots").mapInArrow(add, "cluster long, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(parts)]
    return partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*total).alias("sums")).collect()


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, parts: int = PARTS, scale: int = SCALE, seed: int = 1) -> Clustering:
    """``rounds`` rounds of k-means, then a last assignment."""
    state = stored(integers(vectors, parts, scale), "integers")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = state.orderBy(drawn.asc_nulls_last(), "v").select("v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts)
    if not len(centroids):
        return Clustering(state.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids)
    state = _with_products(state, centroids)
    for _ in range(rounds):
        moved = centroids.copy()
        for row in _member_sums(state, centroids):
            moved[row["cluster"]] = [int(s) // row["n"] for s in row["sums"]]
        state, centroids = _with_products(state, moved - centroids), moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = distances(batch.column(1).to_numpy(), _matrix(batch.column(2), len(centroids)), centroids)
            columns = [batch.column(0), pa.array(every.argmin(axis=1), pa.int32()), pa.array(every.min(axis=1), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return Clustering(state.select("vec_id", "length", "dots").mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids)


def with_inertia(found: Clustering) -> DataFrame:
    """The assigned rows with cluster_inertia, inertia and centroid_sha256 (of the components, joined by commas)."""
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    held = {r["cluster"]: int(r["d"]) for r in found.assigned.groupBy("cluster").agg(total.alias("d")).collect()}  # k rows
    rows = [(j, held[j], sum(held.values()), ",".join(map(str, c.tolist()))) for j, c in enumerate(found.centroids) if j in held]
    known = found.assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid string")
    known = known.select("cluster", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))
    return found.assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
