"""Approximate nearest neighbours by shifted space-filling curves.

1. Equal vectors are one entry with its ``k`` + 1 smallest ids, so any number of copies costs one row.
2. Each of ``curves`` orderings turns a vector into the place of its projection on a Hilbert curve: a random plane of
   ``DIMS`` orthogonal directions, shifted at random, on a grid of 2**``BITS`` cells a side.
3. Spark ranges the entries of a curve by their place into ``blocks`` blocks of about equal size; the borders come from quantiles
   of a sample of about ``BORDER_SAMPLE`` entries (the grids' from ``GRID_SAMPLE``), every entry has a block.  A query looks at the blocks around its own, ``window`` of all of them.
4. Each block ranks its entries for its queries by exact Euclidean distance, in double precision, and keeps the best
   ``k`` + 1; lists of blocks and curves merge on the query.

Points without structure in many dimensions have no near windows on any curve: for them the window decides the recall, and it is
a share of all entries.  For clustered or low-dimensional vectors a smaller one does.  The README has measured figures.

Edge cases: vectors that are NULL, zero or hold NULL or non-finite components, and vectors not of the length of the table's
first one by id, take no part, as query or as candidate; rows with a NULL id take no part; a query never finds its own
row, but finds equal vectors of other rows; ties go to the smaller id, repeated ids count once; with fewer candidates than
``k`` all are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tripleframe.llm.shared import stored

K = 10
CURVES, DIMS, BITS = 8, 6, 5
WINDOW = 0.26  # share of all blocks that a query looks at on a curve
BLOCK_ROWS = 2_000
BORDER_SAMPLE, GRID_SAMPLE = 100_000, 4_000
QUERIES_AT_ONCE = 20_000
ROWS_OUT = 10_000  # pairs of a query and a block sent on at once


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid cells (row, dimension), by undoing the curve's turns from the coarsest bit down."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(dims):
            upper = (x[i] >> bit & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            place = place << 1 | x[i] >> bit & 1
    return place


def planes(size: int, curves: int, dims: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions (curve, dimension, component) and shifts in cells (curve, dimension)."""
    rng = np.random.default_rng(seed)
    dims = min(dims, size)
    return np.stack([np.linalg.qr(rng.normal(size=(size, dims)))[0].T for _ in range(curves)]), rng.random((curves, dims))


def usable(vector: Column, size: int) -> Column:
    numbers = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite & F.exists(numbers, lambda x: x != 0), F.lit(False))


def _as_matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _entries(vectors: DataFrame, k: int) -> DataFrame:
    """entry (smallest id), ids (the k + 1 smallest), v: every distinct vector once."""
    order = Window.partitionBy("v").orderBy("vec_id")
    # the rank filter cuts every group to k + 1 rows inside each map task
    few = vectors.dropDuplicates(["v", "vec_id"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


class Curves:
    """Places of vectors on the curves; the grids cover four deviations around the mean of a sample of vectors."""

    def __init__(self, sample: np.ndarray, curves: int) -> None:
        self.directions, self.shifts = planes(sample.shape[1], curves, DIMS)
        self.bits = min(BITS, 60 // self.directions.shape[1])
        seen = np.einsum("cdi,ri->rcd", self.directions, sample)
        self.low = seen.mean(axis=0) - 4 * seen.std(axis=0)
        self.side = np.maximum(8 * seen.std(axis=0), 1e-300)

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Places (row, curve)."""
        top = (1 << self.bits) - 1
        out = np.empty((len(rows), len(self.directions)), np.int64)
        for c, d in enumerate(self.directions):
            cell = (rows @ d.T - self.low[c]) / self.side[c] * top + self.shifts[c]
            out[:, c] = hilbert(np.clip(cell, 0, top).astype(np.int64), self.bits)
        return out


def neighbours(
    vectors: DataFrame, is_query: Column, k: int = K, curves: int = CURVES, window: float = WINDOW, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (distance) of the nearest rows found for the rows that ``is_query`` picks."""
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    named = named.where("vec_id IS NOT NULL AND size(v) > 0")
    size = named.agg(F.min_by(F.size("v"), "vec_id")).first()[0]
    if size is None:
        return empty
    good = named.where(usable(F.col("v"), size)).withColumn("v", F.col("v").cast("array<double>"))
    entries = stored(_entries(good.select("vec_id", "v"), k), "entries")
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(GRID_SAMPLE).select("v").collect()
    if not sample:
        return empty
    lines = Curves(np.array([r["v"] for r in sample]), curves)
    queries = good.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    count, asking = entries.count(), queries.count()
    n_blocks = math.ceil(count / block_rows)
    reach = max(0, math.ceil((n_blocks * window - 1) / 2))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = lines.places(_as_matrix(batch.column(1), size))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.list_(pa.int64()))], ["entry", "places"])

    located = stored(entries.select("entry", "v").mapInArrow(locate, "entry long, places array<long>"), "places")
    share = min(1.0, BORDER_SAMPLE / count)
    sampled = located.where(F.pmod(F.xxhash64("entry"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    cuts = F.array(*[F.lit(i / n_blocks) for i in range(1, n_blocks)])
    quantiles = [F.percentile_approx(F.get("places", F.lit(c)), cuts, F.lit(max(10_000, 10 * n_blocks))).alias(str(c)) for c in range(curves)]
    # n_blocks - 1 borders for each curve
    edges = [np.array(x, np.int64) for x in sampled.agg(*quantiles).first()] if n_blocks > 1 else [np.empty(0, np.int64)] * curves
    # so many parts of the queries that those of a block stay few
    parts = max(1, math.ceil(asking * min(1.0, (2 * reach + 1) / n_blocks) / QUERIES_AT_ONCE))

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal places on a border are dealt to the blocks between its borders by their id."""
        for batch in batches:
            if batch.num_rows:
                entry, at = batch.column(0).to_numpy(), _as_matrix(batch.column(1), curves).astype(np.int64)
                low = np.stack([np.searchsorted(e, at[:, c], "left") for c, e in enumerate(edges)], axis=1)
                high = np.stack([np.searchsorted(e, at[:, c], "right") for c, e in enumerate(edges)], axis=1)
                blocks = low + entry[:, None] % (high - low + 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(blocks), pa.list_(pa.int64()))], ["entry", "blocks"])

    dealt = entries.join(located.mapInArrow(to_blocks, "entry long, blocks array<long>"), "entry")
    by_block = dealt.select(F.posexplode("blocks").alias("curve", "block"), "ids", "v")
    by_block = by_block.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    spread = queries.mapInArrow(_query_blocks(lines, edges, reach, n_blocks, size), "query_id long, v array<double>, curve int, block long")
    spread = spread.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    keys = ["curve", "block", "part"]
    best = by_block.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(_nearest(k, size), "query_id long, vec_id long, score double")
    merged = best.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _query_blocks(lines: Curves, edges: list[np.ndarray], reach: int, n_blocks: int, size: int):
    """Each query once for every block of its windows; windows at an end of a curve are as wide as others."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = lines.places(_as_matrix(batch.column(1), size))
            width = min(2 * reach + 1, n_blocks)
            for c, e in enumerate(edges):
                own = (np.searchsorted(e, at[:, c], "left") + np.searchsorted(e, at[:, c], "right")) // 2
                low = np.maximum(0, np.minimum(own - reach, n_blocks - 1 - 2 * reach))
                # in slices, so that a batch of queries times blocks stays small
                for start in range(0, len(at) * width, ROWS_OUT):
                    pair = np.arange(start, min(start + ROWS_OUT, len(at) * width))
                    row, step = pair // width, pair % width
                    take = pa.array(row)
                    columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(row), c, np.int32)), pa.array(low[row] + step)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "v", "curve", "block"])

    return spread


def _nearest(k: int, size: int):
    def rank(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if entries.num_rows and queries.num_rows:
            rows, asks = _as_matrix(entries["v"], size), _as_matrix(queries["v"], size)
            names, ids = queries["query_id"].to_numpy(), entries["ids"].to_pylist()
            squares = (rows * rows).sum(axis=1)
            for start in range(0, len(asks), 256):
                part = asks[start : start + 256]
                rough = squares - 2 * part @ rows.T  # the order but for rounding; all that rounding may have moved are measured exactly
                last = np.partition(rough, min(k, len(rows) - 1), axis=1)[:, min(k, len(rows) - 1)]
                room = 1e-9 * (squares.max() + (part * part).sum(axis=1))
                for q in range(len(part)):
                    chosen = np.flatnonzero(rough[q] <= last[q] + room[q])
                    exact = np.sqrt(((rows[chosen] - part[q]) ** 2).sum(axis=1))
                    found = [(d, i) for d, e in zip(exact.tolist(), chosen.tolist()) for i in ids[e] if i != names[start + q]]
                    found.sort()
                    out += [(names[start + q], i, d) for d, i in found[:k]]
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array([r[j] for r in out], t) for j, (n, t) in enumerate(zip(("query_id", "vec_id", "score"), types))})

    return rank
