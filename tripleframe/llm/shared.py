"""Tables of the shared folder and names, for all operators; ``tripleframe.shared`` writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripleframe.session import tune
from tripleframe.shared import new_path, stored

__all__ = ["new_path", "stored", "table", "tokenizer_path", "unused"]


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have, from ``name``."""
    name = f"_{name}"
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a vocabulary file installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
