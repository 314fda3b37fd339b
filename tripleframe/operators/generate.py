"""Applying a caller's text generator to prompts."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tripleframe.functions.shipping import ship_by_value

ship_by_value(__name__)

Generator = Callable[[list[str]], Sequence[str]]


def _answers(generator: Generator, prompts: list[str], retries: int, delay: float, longest: float) -> list[tuple[str | None, str | None]]:
    """(text, error) per prompt; a batch that keeps failing is tried prompt by prompt."""
    problem, wait = "", delay
    for attempt in range(retries):
        try:
            answers = list(generator(prompts))
            if len(answers) != len(prompts):  # nobody knows which answer belongs to which prompt
                raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
            return [(None, "no answer") if text is None else (str(text), None) for text in answers]
        except Exception as error:  # the caller's generator may raise anything
            problem = f"{type(error).__name__}: {error}"
            if attempt + 1 < retries:
                time.sleep(wait)
                wait = min(wait * 2, longest)
    if len(prompts) == 1:
        return [(None, problem)]
    return [_answers(generator, [prompt], retries, delay, longest)[0] for prompt in prompts]


def generate(
    prompts: DataFrame, make_generator: Callable[[], Generator], batch: int = 16, retries: int = 3,
    delay: float = 2.0, longest_delay: float = 25.0, prompt_col: str = "prompt", tasks: int | None = None,
) -> DataFrame:
    """Add ``generated_text`` and ``error`` to every prompt.

    ``make_generator`` builds the client once per task.  A failing batch is retried with growing pauses,
    then split; a prompt that never succeeds keeps its row, with the error.  More or fewer answers than
    prompts are a failed try, an answer ``None`` is an error of its prompt.  With ``tasks`` the prompts are
    spread over so many tasks first, as a small file would keep one task for hours.  Write the result to a
    table before using it twice: generation is costly and need not repeat itself.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField("generated_text", T.StringType()), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make_generator()
        for frame in frames:
            texts = frame[prompt_col].tolist()
            done: list[tuple[str | None, str | None]] = []
            for start in range(0, len(texts), batch):
                done.extend(_answers(generator, texts[start : start + batch], retries, delay, longest_delay))
            yield frame.assign(generated_text=[d[0] for d in done], error=[d[1] for d in done])

    return (prompts.repartition(tasks) if tasks else prompts).mapInPandas(run, schema)


def unfinished(prompts: DataFrame, finished: DataFrame, keys: Sequence[str] = ("run", "doc_id")) -> DataFrame:
    """Prompts without a successful generation yet, to resume a stopped run."""
    done = finished.where(F.col("error").isNull()).select(*keys).distinct()
    return prompts.join(done, list(keys), "left_anti")


LEDGER = "key string, generated_text string, error string"


def _folder(path: str):
    return (fs.LocalFileSystem(), path.removeprefix("file:")) if path.startswith("file:") or "://" not in path else fs.FileSystem.from_uri(path)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """Finished prompts ``(key, generated_text, error)``, one row each; an answer counts before an error."""
    rows = spark.read.schema(LEDGER).parquet(ledger)
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "generated_text", "error")).alias("b")
    return rows.groupBy("key").agg(best).select("key", "b.generated_text", "b.error")


def generate_durably(
    prompts: DataFrame, make_generator: Callable[[], Generator], ledger: str, batch: int = 16, retries: int = 3, delay: float = 2.0,
    longest_delay: float = 25.0, prompt_col: str = "prompt", tasks: int = 8, per_second: float | None = None,
) -> DataFrame:
    """``generate`` with a ledger: a folder all executors share, where every finished batch is a file of its own.

    A prompt is known by the hash of its text, so equal prompts are asked once.  Prompts with an answer in the ledger are not asked
    again; those with an error are.  A batch is written under a draft name and renamed, so a run that is lost at any point
    repeats at most the batch each task was at.  ``per_second`` bounds the prompts asked a second over all tasks.
    """
    spark = prompts.sparkSession
    store, top = _folder(ledger)
    store.create_dir(top, recursive=True)
    key = F.sha2(F.col(prompt_col), 256)
    answered = read_ledger(spark, ledger).where(F.col("error").isNull())
    todo = prompts.select(key.alias("key"), F.col(prompt_col).alias("prompt")).where(F.col("key").isNotNull()).dropDuplicates(["key"])
    todo = todo.join(answered, "key", "left_anti").repartition(tasks)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator, (files, place) = make_generator(), _folder(ledger)
        for frame in frames:
            for start in range(0, len(frame), batch):
                part, began = frame.iloc[start : start + batch], time.monotonic()
                done = _answers(generator, part["prompt"].tolist(), retries, delay, longest_delay)
                table = pa.table({"key": part["key"].tolist(), "generated_text": pa.array([d[0] for d in done], pa.string()), "error": pa.array([d[1] for d in done], pa.string())})
                name = hashlib.sha256("".join(part["key"]).encode()).hexdigest()
                draft = f"{place}/.{name}-{time.time_ns()}"
                with files.open_output_stream(draft) as out:
                    pq.write_table(table, out)
                files.move(draft, f"{place}/{name}-{time.time_ns()}.parquet")
                if per_second:
                    time.sleep(max(0.0, len(part) * tasks / per_second - (time.monotonic() - began)))
            yield pd.DataFrame({"asked": [len(frame)]})

    todo.mapInPandas(ask, "asked long").write.format("noop").mode("overwrite").save()
    answers = read_ledger(spark, ledger)
    return prompts.withColumn("_key", key).join(answers.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
