"""Extraction on a stream of new generation files.

The readers keep no state, so the same operators run on a stream unchanged: each new file of a run is read
once, its triples are appended to the run's folder, and the checkpoint remembers what was done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tripleframe.operators.extract import extract_triples
from tripleframe.sources.records import GENERATIONS, run_of_file


def stream_runs(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Generations from JSON Lines files as they arrive: ``(run, doc_id, generated_text)``."""
    raw = spark.readStream.schema(GENERATIONS).option("maxFilesPerTrigger", files_per_trigger).json(path)
    text = F.coalesce("generated_text", "extraction").alias("generated_text")
    return raw.select(run_of_file().alias("run"), F.col("index").alias("doc_id"), text)


def stream_triples(spark: SparkSession, path: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the triples of new files to ``out``; ``once`` stops after the files present now.

    ``checkpoint`` must be a shared folder: it is what makes a restart continue where it stopped.
    """
    triples = extract_triples(stream_runs(spark, path))
    writer = triples.writeStream.format("parquet").partitionBy("run").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.outputMode("append").start(out)
