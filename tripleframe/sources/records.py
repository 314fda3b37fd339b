"""Readers and writers of corpora, prompts, runs and templates.

A *run* is one result set; on disk it is one file (or one folder) whose name identifies it.  All runs of a
folder are read in one job.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tripleframe.sources.arrays import RANGE, read_json_arrays

_MENTION = "struct<uri:string,surfaceform:string,type:string,start:bigint,end:bigint>"

# Annotated documents as they arrive.
CORPUS = (
    "docid string, title string, uri string, text string, "
    f"entities array<{_MENTION}>, relations array<struct<subject:{_MENTION},predicate:bigint,object:{_MENTION}>>"
)
# Generations; the two runners name the text differently.
GENERATIONS = "index bigint, prompt string, generated_text string, extraction string"

TEMPLATE = T.StructType(
    [
        T.StructField("prefix", T.StringType()), T.StructField("formatter", T.StringType()),
        T.StructField("example variables", T.ArrayType(T.StringType())),
        T.StructField("input variables", T.ArrayType(T.StringType())), T.StructField("suffix", T.StringType()),
    ]
)


def run_of_file() -> Column:
    """File name without its ending."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON Lines as rows; a line that does not fit the schema gives NULLs."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_checked_records(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON Lines as (rows, broken lines ``(file, line)``): a line that does not parse is told apart, not lost."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_name").alias("file"), "value")
    read = lines.withColumn("r", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col("r._corrupt_record").isNotNull()
    return read.where(~broken).select(*[F.col("r")[f.name].alias(f.name) for f in kind.fields]), read.where(broken).select("file", F.col("value").alias("line"))


def read_corpus(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Annotated documents of a folder with ``split=...`` parts; ``doc_id`` is the document's own id."""
    reader = spark.read.schema(CORPUS + ", split string")
    return reader.format(form).load(path).withColumn("doc_id", F.col("docid"))


def _run_of(path: Column) -> Column:
    """File name of a path without its ending."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def read_prompt_arrays(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Files that hold one JSON array of prompts: ``(run, doc_id, prompt)`` with the position as id; a file is read in ranges of ``size`` bytes."""
    value = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>")
    return read_json_arrays(spark, path, size).select(_run_of(F.col("path")).alias("run"), F.col("pos").alias("doc_id"), F.get(value, F.lit(0)).alias("prompt"))


def read_runs(spark: SparkSession, path: str, lines: bool = False, size: int = RANGE) -> DataFrame:
    """Generations of all runs of a folder: ``(run, doc_id, prompt, generated_text)``.

    Files hold one JSON array each, read in ranges of ``size`` bytes, or JSON Lines with ``lines``.  Either name of the text is accepted.
    """
    if lines:
        raw = spark.read.schema(GENERATIONS).json(path).withColumn("run", run_of_file())
    else:
        raw = read_json_arrays(spark, path, size).select(_run_of(F.col("path")).alias("run"), F.from_json("value", GENERATIONS).alias("g")).select("run", "g.*")
    return raw.select("run", F.col("index").alias("doc_id"), "prompt", F.coalesce("generated_text", "extraction").alias("generated_text"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Templates of a folder, one JSON file each, named by the file."""
    return spark.read.schema(TEMPLATE).option("multiLine", True).json(path).select(run_of_file().alias("name"), "*")


def template_texts(templates: DataFrame) -> dict[str, dict[str, str]]:
    """The templates as plain text for compilation: a handful of rows, by their nature small."""
    parts = ("prefix", "formatter", "suffix")
    return {row["name"]: {part: row[part] or "" for part in parts} for row in templates.select("name", *parts).collect()}


def write_templates(spark: SparkSession, templates: Mapping[str, Mapping], path: str) -> None:
    """Templates as one JSON row per folder ``name=...``."""
    rows = [
        (name, t.get("prefix"), t["formatter"], t.get("example variables"), t.get("input variables"), t.get("suffix"))
        for name, t in templates.items()
    ]
    schema = T.StructType([T.StructField("name", T.StringType()), *TEMPLATE.fields])
    spark.createDataFrame(rows, schema).write.mode("overwrite").partitionBy("name").json(path)


def read_written_templates(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_templates`` wrote."""
    return spark.read.schema(T.StructType([*TEMPLATE.fields, T.StructField("name", T.StringType())])).json(path)


def write_split(df: DataFrame, path: str) -> None:
    """JSON Lines, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def write_runs(df: DataFrame, path: str, form: str = "parquet") -> None:
    """One folder per run; only the runs present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").format(form).save(path)
