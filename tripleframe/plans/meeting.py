"""Rows that meet by key in Python tasks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def met(
    left: DataFrame, right: DataFrame, key: str, identity: Sequence[str], rows: int,
    meet: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema,
) -> DataFrame:
    """``meet(left rows, right rows)`` of every key that ``left`` has.

    ``right`` holds a bounded number of rows per key.  The rows of ``left`` may be any number: those of a hot key are dealt
    to cells of about ``rows`` rows by a hash of ``identity``, and each cell gets a copy of the key's right rows.  A cell is a
    column of its own, so that cells of one key go to different tasks.
    """
    cells = left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_cells"))
    cell = lambda number: F.concat_ws("/", F.col(key), number.cast("string"))
    one = left.join(cells, key).withColumn("_cell", cell(F.pmod(F.xxhash64(*identity), F.col("_cells")))).drop("_cells")
    numbers = F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))
    other = right.join(cells, key).withColumn("_n", numbers).withColumn("_cell", cell(F.col("_n"))).drop("_cells", "_n")

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return meet(a.drop(columns="_cell"), b.drop(columns="_cell"))

    return one.groupBy("_cell").cogroup(other.groupBy("_cell")).applyInPandas(both, schema)
