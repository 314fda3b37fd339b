"""Knowledge-base tables on disk."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

LABELS = "id string, kind string, label string, aliases array<string>, description string, popularity bigint"
STATEMENTS = "s string, p string, o string"
CONSTRAINTS = "property string, ctype string, class_id string, class_label string"


class KnowledgeBase(NamedTuple):
    label: DataFrame
    statement: DataFrame
    constraint: DataFrame


def read_kb(spark: SparkSession, path: str) -> KnowledgeBase:
    """The three tables of a snapshot folder."""
    return KnowledgeBase(
        spark.read.schema(LABELS).parquet(f"{path}/label"),
        spark.read.schema(STATEMENTS).parquet(f"{path}/statement"),
        spark.read.schema(CONSTRAINTS).parquet(f"{path}/constraint"),
    )


def write_kb(kb: KnowledgeBase, path: str) -> None:
    """Write a snapshot folder: labels by kind, statements sorted by property inside each file.

    The sort lets a reader of one property, such as the class graph, skip most row groups; it adds no
    shuffle.
    """
    kb.label.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/label")
    kb.statement.sortWithinPartitions("p").write.mode("overwrite").parquet(f"{path}/statement")
    kb.constraint.write.mode("overwrite").parquet(f"{path}/constraint")


def write_kb_tables(kb: KnowledgeBase, name: str, buckets: int) -> None:
    """Catalog tables ``<name>_label``, ``<name>_statement`` and ``<name>_constraint``, bucketed by the keys they are joined by.

    Joins then read the labels by id and the statements by (s, p, o) where they lie; only what is asked is shuffled.  That needs at
    least as many ``buckets`` as ``spark.sql.shuffle.partitions``.
    """
    for table, df, keys in (("label", kb.label, ["id"]), ("statement", kb.statement, ["s", "p", "o"]), ("constraint", kb.constraint, ["property"])):
        dealt = df.repartition(buckets, *keys)  # one file a bucket
        dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(f"{name}_{table}")


def read_kb_tables(spark: SparkSession, name: str) -> KnowledgeBase:
    """What ``write_kb_tables`` wrote."""
    return KnowledgeBase(*(spark.table(f"{name}_{table}") for table in ("label", "statement", "constraint")))
