"""Shards of bounded size by extendible hashing.

The directory is indexed by the leading bits of a hash of the key.  A bucket over the byte limit splits on
its next bit, others do not, until every shard fits.  Splitting is worked out on sums: bytes are summed by
the first bits of the hash, these cells are summed up to all their prefixes, and a cell belongs to its
shortest prefix that fits.  Cells that fit nowhere go on with more bits; that takes one or two passes.

What bits cannot separate: a row over the limit has a shard alone; rows of one key that are over the limit
together are dealt to parts (``-0``, ``-1``, ...) of so many rows that the longest of them would fit as often.

Edge cases: a NULL text counts 0 bytes; a NULL key hashes as an empty one; repeated rows are rows of one
key; an empty table gives no rows; other columns are not read by ``shards`` and pass through ``write_shards``,
which adds the shard as a folder name.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tripleframe.llm.shared import stored, unused

BITS = 60
SHARD_BYTES = 256 << 20


def hashed(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(value: str, bits: int, depth: Column | int) -> Column:
    """The first ``depth`` of ``bits`` bits."""
    return F.call_function("shiftright", F.col(value), (F.lit(bits) - depth).cast("int"))


def _name(prefix: Column, depth: Column) -> Column:
    return F.when(depth > 0, F.lpad(F.bin(prefix), depth, "0")).otherwise("")


def _step(rows: DataFrame, base: int, bits: int, limit: int) -> DataFrame:
    """cell, depth: the shortest prefix from ``base`` to ``bits`` bits that fits, for the cells that have one."""
    cells = rows.groupBy(_prefix("hash", BITS, bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
    up = cells.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(bits)))).withColumn("prefix", _prefix("cell", bits, F.col("depth")))
    sums = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fits = sums.where((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))).select("depth", "prefix")
    return up.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))


def _parts(rows: DataFrame, limit: int) -> DataFrame:
    """The rows with ``part``, their number among the parts of their key; -1 where the key needs none."""
    over = rows.groupBy("hash").agg(F.sum("bytes").alias("all"), F.max("bytes").alias("longest"), F.count(F.lit(1)).alias("n"))
    over = stored(over.where((F.col("all") > limit) & (F.col("n") > 1)).select("hash", F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("longest"))).alias("each")), "over")
    if over.isEmpty():
        return rows.withColumn("part", F.lit(-1).cast("long"))
    # numbered by task first, so that no task holds all rows of a key
    tasks = stored(rows.withColumn("task", F.spark_partition_id()), "tasks")
    inside = F.row_number().over(Window.partitionBy("hash", "task").orderBy("bytes")) - 1
    before = F.coalesce(F.sum("k").over(Window.partitionBy("hash").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heavy = tasks.join(over, "hash").withColumn("inside", inside)
    starts = heavy.groupBy("hash", "task").agg(F.count(F.lit(1)).alias("k")).select("hash", "task", before.alias("before"))
    dealt = heavy.join(starts, ["hash", "task"]).withColumn("part", F.floor((F.col("before") + F.col("inside")) / F.col("each")))
    light = tasks.join(over, "hash", "left_anti").withColumn("part", F.lit(-1).cast("long"))
    return light.drop("task").unionByName(dealt.select(*light.drop("task").columns))


def _placed(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (with hash and bytes) with shard and depth."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(BITS, max(4, math.ceil(math.log2(total / limit + 1)) + 3))
    base, left, done = 0, _parts(rows, limit), []
    while True:
        found = stored(_step(left, base, bits, limit), "directory")
        cell = left.withColumn("cell", _prefix("hash", BITS, bits))
        name = F.concat(_name(_prefix("cell", bits, F.col("depth")), F.col("depth")), F.when(F.col("part") >= 0, F.concat(F.lit("-"), F.col("part").cast("string"))).otherwise(""))
        done.append(cell.join(found, "cell").withColumn("shard", name).drop("cell", "part"))
        rest = cell.join(found, "cell", "left_anti").drop("cell")
        if bits == BITS or rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        base, bits, left = bits, min(BITS, bits + 12), rest


def shards(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bytes, shard (its hash bits), depth (their number) of every row."""
    rows = docs.select(F.col(key), hashed(F.col(key)).alias("hash"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    return _placed(stored(rows, "sized"), limit).select(key, "bytes", "shard", "depth")


def read_shards(spark: SparkSession, folder: str, schema: T.StructType, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bytes, shard, depth of every row of the files that ``write_shards`` wrote from a table of the given schema."""
    mark = unused("shard", spark.createDataFrame([], schema))
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(mark, T.StringType())])).parquet(folder)
    # the one shard of a small table has an empty name, which a folder can't show
    shard = F.coalesce(F.col(mark), F.lit(""))
    depth = F.length(F.regexp_replace(shard, "-.*", "")).cast("int")
    return rows.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), shard.alias("shard"), depth.alias("depth"))


def write_shards(docs: DataFrame, folder: str, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> None:
    """All columns of ``docs`` as Parquet, a folder ``shard=<bits>`` with one file for each shard."""
    held = docs.select(F.struct(*docs.columns).alias("row"), hashed(F.col(key)).alias("hash"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    mark = unused("shard", docs)
    placed = _placed(held, limit).select("row.*", F.col("shard").alias(mark))
    placed.repartition(F.col(mark)).sortWithinPartitions(mark).write.partitionBy(mark).parquet(folder)
