"""Files that hold one large JSON array, read in byte ranges cut at the borders of elements.

Where a byte range begins, nobody knows whether it lies in a string.  So every range is first scanned under each of the three states it
may begin in (outside strings, inside one, inside behind a backslash): the state it ends in, how much deeper it ends, and its commas by
depth.  The driver chains these few numbers per range, which tells every range its true state, depth and element number.  Then
a Python data source reads each range as a partition of its own: the elements whose opening mark, the first bracket or a
comma between elements, lies in the range, the last one to its end beyond it.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tripleframe.functions.shipping import ship_by_value

ship_by_value(__name__)

RANGE = 32 << 20
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2


def _opened(path: str):
    files, place = (fs.LocalFileSystem(), path.removeprefix("file:")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
    return files.open_input_file(place)


def structure(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places, signs and depths (after the sign, from 0) of brackets and commas outside strings, and the state at the end."""
    b = np.frombuffer(data, np.uint8)
    slash = b == 92
    run = np.arange(len(b)) - np.maximum.accumulate(np.where(slash, -1, np.arange(len(b))))  # backslashes up to here
    if state == ESCAPED:
        run = run + (run == np.arange(1, len(b) + 1))  # one more before the range
    before = np.concatenate([[state == ESCAPED], run[:-1]])
    quotes = (b == 34) & (before % 2 == 0)
    inside = (np.cumsum(quotes) + (state != OUTSIDE)) % 2 == 1
    places = np.flatnonzero(np.isin(b, np.frombuffer(b"[]{},", np.uint8)) & ~inside)
    signs = b[places]
    depth = np.cumsum(np.isin(signs, (91, 123)).astype(np.int64) - np.isin(signs, (93, 125)))
    if not len(b):
        return places, signs, depth, state
    return places, signs, depth, (ESCAPED if run[-1] % 2 else INSIDE) if inside[-1] else OUTSIDE


def _scanned(files: DataFrame, size: int) -> DataFrame:
    """``(path, start, stop, ends)``: what ``structure`` says of every range, by state."""
    ranges = files.select("path", F.col("length").alias("file_size"), F.explode(F.expr(f"sequence(0L, length - 1, {size}L)")).alias("start"))
    ranges = ranges.withColumn("stop", F.least(F.col("start") + size, F.col("file_size")))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, start, stop in zip(batch["path"], batch["start"], batch["stop"]):
                with _opened(path) as source:
                    data = source.read_at(stop - start, start)
                ends = []
                for state in (OUTSIDE, INSIDE, ESCAPED):
                    _, signs, depth, end = structure(data, state)
                    commas = Counter(depth[signs == 44].tolist())
                    ends.append([end, int(depth[-1]) if len(depth) else 0, {str(k): n for k, n in commas.items()}])
                rows.append((path, start, stop, json.dumps(ends)))
            yield pd.DataFrame(rows, columns=["path", "start", "stop", "ends"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n).mapInPandas(scan, "path string, start long, stop long, ends string")


def _chained(rows: list) -> list[dict]:
    """The true state, depth and number of commas between elements before every range."""
    out, state, depth, commas, path = [], OUTSIDE, 0, 0, None
    for row in sorted(rows, key=lambda r: (r["path"], r["start"])):
        if row["path"] != path:
            state, depth, commas, path = OUTSIDE, 0, 0, row["path"]
        out.append({"path": path, "start": row["start"], "stop": row["stop"], "state": state, "depth": depth, "commas": commas})
        end, deeper, found = json.loads(row["ends"])[state]
        commas += found.get(str(1 - depth), 0)
        state, depth = end, depth + deeper
    return out


class Range(InputPartition):
    def __init__(self, plan: dict) -> None:
        super().__init__(plan)
        self.plan = plan


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.plans, self.size = json.loads(options["ranges"]), int(options["size"])

    def partitions(self) -> list[InputPartition]:
        return [Range(plan) for plan in self.plans]

    def read(self, partition: Range) -> Iterator[tuple]:
        plan, held = partition.plan, b""
        at, state, depth, number = plan["start"], plan["state"], plan["depth"], plan["commas"]
        begin = None  # number of the element that is being read
        with _opened(plan["path"]) as source:
            total = source.size()
            while at < total and (at < plan["stop"] or begin is not None):
                data = source.read_at(min(self.size, plan["stop"] - at) if at < plan["stop"] else min(1 << 16, self.size, total - at), at)
                places, signs, depths, state = structure(data, state)
                depths, last = depths + depth, 0
                # the marks of the array itself: its brackets and the commas between its elements
                own = ((signs == 91) & (depths == 1)) | ((signs == 44) & (depths == 1)) | ((signs == 93) & (depths == 0))
                for place, sign in zip(places[own].tolist(), signs[own].tolist()):
                    if begin is not None:
                        value = (held + data[last:place]).strip()
                        if value:
                            yield plan["path"], begin, value.decode("utf-8", "replace")
                    held, last, begin = b"", place + 1, None
                    number += sign == 44
                    if at + place < plan["stop"] and sign != 93:
                        begin = number
                    elif at + place >= plan["stop"]:
                        return
                held = held + data[last:] if begin is not None else b""
                depth = int(depths[-1]) if len(depths) else depth
                at += len(data)


class JsonArrays(DataSource):
    """``(path, pos, value)``: every element of the arrays as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "json_arrays"

    def schema(self) -> str:
        return "path string, pos bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options)


def read_json_arrays(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Elements ``(path, pos, value)`` of all files of ``path``, each of which holds one JSON array, in ranges of ``size`` bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    plans = _chained(_scanned(files, size).collect())  # a few numbers per range
    spark.dataSource.register(JsonArrays)
    return spark.read.format("json_arrays").option("ranges", json.dumps(plans)).option("size", str(size)).load()
