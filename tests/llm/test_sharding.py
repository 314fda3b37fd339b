"""Directories against splitting one bucket at a time."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tripleframe.llm import sharding as s


def bits_of(key):
    return bin(int(hashlib.md5(str(key).encode()).hexdigest()[:15], 16))[2:].zfill(60)


def split(rows, limit, prefix=""):
    """{key: shard} by splitting buckets until they fit or hold one key."""
    if sum(b for _, b in rows) <= limit or len({k for k, _ in rows}) == 1:
        return {k: prefix for k, _ in rows}
    out = {}
    for bit in "01":
        part = [(k, b) for k, b in rows if bits_of(k)[len(prefix)] == bit]
        if part:
            out |= split(part, limit, prefix + bit)
    return out


@pytest.mark.parametrize("limit", [1, 150, 1000, 10**9])
def test_directory_is_that_of_single_splits(spark, limit):
    rows = [(i, "x" * (i * 7 % 41)) for i in range(300)] + [(1000, "é" * 700), (1001, None), (1002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bytes", F.lit("clash")).withColumn("shard", F.lit(0))
    got = {r["doc_id"]: (r["shard"], r["bytes"], r["depth"]) for r in s.shards(docs, limit).collect()}
    sizes = [(k, len((t or "").encode())) for k, t in rows]
    want = split(sizes, limit)
    assert got == {k: (want[k], b, len(want[k])) for k, b in sizes}


def test_rows_of_one_key_are_dealt_to_parts(spark, tmp_path):
    rows = [(1, "x" * 30)] * 50 + [(1, "y" * 60)] + [(2, "z" * 500)] + [(None, "n"), (3, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = s.shards(docs, 120).groupBy("shard").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in got) == len(rows)
    assert all(r["b"] <= 120 or r["n"] == 1 for r in got)
    folder = str(tmp_path / "out")
    s.write_shards(docs, folder, 120)
    back = spark.read.parquet(folder)
    assert back.count() == len(rows) and back.groupBy("_shard").count().count() == len(got)
    assert back.select(F.input_file_name().alias("f"), "_shard").distinct().count() == len(got)


def test_empty_table(spark):
    assert s.shards(spark.createDataFrame([], "doc_id long, text string"), 10).count() == 0
