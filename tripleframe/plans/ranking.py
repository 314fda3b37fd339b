"""Rank and top-k pieces that stay spread over the cluster whatever the key distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripleframe.shared import stored


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key, numbered from 1.

    The rank filter lets Spark cut every key to ``k`` rows inside each map task before the shuffle, so
    even a key with a third of all rows sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def spread_nulls(key: Column, *identity: str) -> Column:
    """The key, with a value of its own for every row whose key is NULL.

    NULL keys match nothing, but an outer join would still send all of them to one task.  A key that starts
    with a zero character is no id, so the join finds the same rows.
    """
    return F.coalesce(key, F.concat(F.lit("\0"), F.hex(F.xxhash64(*identity))))


def seeded_hash(seed: int | str, key: Column) -> Column:
    """A hexadecimal hash that orders rows at random but the same way on every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def global_rank(df: DataFrame, hashed: str, ties: Sequence[str], rank: str = "rank") -> DataFrame:
    """Number all rows from 1 in the order of a uniform hexadecimal hash column, without a one-task sort.

    The hash is cut into 65,536 buckets by its first four digits.  Their sizes, at most 65,536 small rows
    whatever the table size, give each bucket its offset; rows are ranked inside their bucket only.
    """
    bucketed = df.withColumn("_bucket", F.substring(F.col(hashed), 1, 4))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(hashed, *ties))
    return (
        bucketed.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(rank, F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_inside", "_offset")
    )


def positions(df: DataFrame, order: Sequence[Column], rank: str = "pos") -> DataFrame:
    """Number all rows from 0 in the given order, without a one-task sort; the numbered table is written once.

    Rows are range-partitioned and sorted; the sizes of the partitions, one row each, give every row its number.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(sorted_.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "sorted")
    sizes = dealt.groupBy("_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return dealt.join(F.broadcast(shift), "_part").withColumn(rank, F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")
