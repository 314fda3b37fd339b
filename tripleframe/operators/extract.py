"""Text to triples: the reader cascade, its canonical output, and the malformed rest.

No operator here shuffles: everything is a projection, an explode or a filter of the input rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tripleframe.functions import readers as R
from tripleframe.functions.literals import literal_json, may_be_literal
from tripleframe.functions.shapes import ITEMS, string_items, variant_items
from tripleframe.functions.text import let, strip


def _named(reader: str, value: Column, field: str) -> Column:
    """``struct(reader, value)``, or NULL when the reader found nothing."""
    return let(value, lambda v: F.when(v.isNotNull(), F.struct(F.lit(reader).alias("reader"), v.alias(field))))


def _first_rows(*options: tuple[str, Column]) -> Column:
    """What the first successful pattern reader found, with its name."""
    return F.coalesce(*[_named(name, rows, "rows") for name, rows in options])


def _before_literals(text: Column, strict_order: bool) -> Column:
    """Everything that needs no Python, of a stripped text: JSON, the first pattern readers, the span of a list of objects."""

    def early(t: Column) -> Column:
        return _first_rows(
            ("subject_lines", R.subject_lines(t, closed_only=strict_order)),
            ("subject_blocks", R.subject_blocks(t, last_closed_only=strict_order)),
            ("quoted_lists", R.quoted_lists(t)),
            ("nested_lists", R.nested_lists(t, stop_when_empty=strict_order)),
        )

    def with_span(t: Column, json: Column, rows: Column, span: Column) -> Column:
        return F.struct(
            t.alias("text"), json.alias("json"), rows.alias("early"), span.alias("span"),
            R.dict_span_json(span).alias("span_json"),
        )

    def with_early(t: Column, json: Column, rows: Column) -> Column:
        span = F.when(json.isNull() & rows.isNull(), R.dict_span(t))
        return let(span, lambda sp: with_span(t, json, rows, sp))

    def with_json(t: Column, json: Column) -> Column:
        return let(F.when(json.isNull(), early(t)), lambda rows: with_early(t, json, rows))

    return let(R.json_value(text), lambda json: with_json(text, json))


def _decide(seen: Column, literal: Column, capitals: bool, strict_order: bool) -> Column:
    """``struct(reader, status, items)`` from the first step and the Python literals."""
    t, early = seen["text"], seen["early"]

    def answer(data: Column, rows: Column) -> Column:
        plain = string_items(rows["rows"])
        if not capitals:  # blocks give objects with capitalised keys
            plain = F.when(rows["reader"] != "subject_blocks", plain)
        items = (
            F.when(data.isNotNull(), variant_items(data["value"], capitals))
            .when(rows.isNotNull(), plain)
            .otherwise(F.array().cast(ITEMS))
        )
        reader = F.coalesce(data["reader"], rows["reader"], F.lit("none"))
        return let(
            items,
            lambda i: F.struct(
                reader.alias("reader"),
                F.when(i.isNull(), "unreadable").when(F.size(i) == 0, "empty").otherwise("triples").alias("status"),
                i.alias("items"),
            ),
        )

    def last(data: Column, rows: Column) -> Column:
        final = F.when(data.isNull(), _first_rows(("brackets", R.brackets(t)), ("dash_lines", R.dash_lines(t))))
        return let(F.coalesce(rows, final), lambda r: answer(data, r))

    def numbered(data: Column, rows: Column) -> Column:
        objects = F.when(rows.isNull(), _named("numbered_dicts", R.numbered_dicts(t), "value"))
        return let(F.coalesce(data, objects), lambda d: last(d, rows))

    def patterns(data: Column) -> Column:
        late = _first_rows(
            ("tuples", R.tuples(t)),
            ("numbered_lists", R.numbered_lists(t)),
            ("numbered_dashes", R.numbered_dashes(t, last_line_only=strict_order)),
        )
        return let(F.when(data.isNull(), F.coalesce(early, late)), lambda rows: numbered(data, rows))

    span_value = F.coalesce(seen["span_json"], F.try_parse_json(literal["sets" if strict_order else "span"]))
    data = F.coalesce(
        _named("json", seen["json"], "value"),
        _named("literal", F.try_parse_json(literal["whole"]), "value"),
        F.when(early.isNull(), _named("dict_list", span_value, "value")),
        F.when(early.isNull(), _named("fenced_json", R.fenced_json(t), "value")),
    )
    return let(data, patterns)


def read_texts(
    df: DataFrame, text_col: str = "generated_text", capitals: bool = True, strict_order: bool = False
) -> DataFrame:
    """Add ``reader``, ``status`` and ``items`` to every generated text.

    The readers are tried in order and the first that finds something wins.  ``status`` is ``triples``,
    ``empty`` (nothing found, or an empty list) or ``unreadable`` (an answer of unknown shape).

    By default an empty ``[[...]]`` span lets later readers try, unterminated ``Subject:`` lines and blocks
    count, and every line of a numbered dash list is kept.  ``strict_order=True`` gives the historical
    behaviour instead: the span stops the search, unterminated ones are lost, one block or line survives, and
    a list that holds a set keeps nothing but its sets.  A set is read in the order of its values.

    Each of the two native steps is one nested expression, so that a filter or explode put on top by the
    optimizer copies it at most once.
    """
    seen, text = F.col("_seen"), F.col("_seen.text")
    whole = F.when(seen["json"].isNull() & may_be_literal(text), text)
    span = F.when(seen["span_json"].isNull(), seen["span"])
    return (
        # a column of its own, used more than once: it stays compiled with what makes the text
        df.withColumn("_stripped", strip(F.col(text_col)))
        .withColumn("_seen", _before_literals(F.col("_stripped"), strict_order))
        .withColumn("_literal", literal_json(whole, span))
        .withColumn("_read", _decide(seen, F.col("_literal"), capitals, strict_order))
        .select(*df.columns, "_read.reader", "_read.status", "_read.items")
    )


def explode_items(read: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per item: position, parts, and ``s p o`` where the item has three parts."""
    part = F.col("item.parts")
    three = F.size(part) == 3
    return (
        # the outer explode keeps the optimizer from testing the size of the unread items first
        read.select(*keep, "reader", "status", F.posexplode_outer("items").alias("pos", "item"))
        .where(F.col("pos").isNotNull())
        .withColumn("well_formed", three)
        .select(
            *keep, "reader", "status", "pos", part.alias("parts"), F.col("item.all_strings").alias("all_strings"),
            "well_formed",
            *[F.when(three, F.get(part, F.lit(i))).alias(name) for i, name in enumerate(("s", "p", "o"))],
        )
    )


def extract_triples(
    df: DataFrame,
    text_col: str = "generated_text",
    keep: Sequence[str] = ("run", "doc_id"),
    capitals: bool = True,
    strict_order: bool = False,
) -> DataFrame:
    """Every triple of every generated text: ``keep``, reader, position, parts and ``s p o``."""
    return explode_items(read_texts(df, text_col, capitals, strict_order), keep)


def unreadable(read: DataFrame) -> DataFrame:
    """Texts whose answer has no known shape."""
    return read.where(F.col("status") == "unreadable")


def split_valid(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with three parts, malformed items)."""
    return triples.where("well_formed"), triples.where(~F.col("well_formed"))


def malformed_counts(triples: DataFrame) -> DataFrame:
    """Items and malformed items per run."""
    return triples.groupBy("run").agg(
        F.count(F.lit(1)).alias("triples"), F.count_if(~F.col("well_formed")).alias("malformed")
    )


def canonical_triples(triples: DataFrame) -> DataFrame:
    """Well-formed triples with lower-case parts; ``matchable`` tells whether all parts were strings."""
    valid, _ = split_valid(triples)
    return valid.withColumns({c: F.lower(c) for c in ("s", "p", "o")}).withColumn("matchable", F.col("all_strings"))


def extract_fenced_json(
    df: DataFrame, text_col: str = "generated_text", keep: Sequence[str] = ("run", "doc_id")
) -> DataFrame:
    """Triples of answers that are one list of subject/predicate/object objects, fenced or not.

    Newlines and fences are dropped first.  An answer of another kind gives one row with status
    ``malformed`` and no triple; it never stops the job.
    """
    bare = strip(F.col(text_col))
    for noise in ("\n", "```json", "```"):
        bare = F.replace(bare, F.lit(noise), F.lit(""))
    listed = F.from_json(F.col("_bare"), "array<struct<subject:string,predicate:string,object:string>>")
    complete = F.forall("_list", lambda x: x["subject"].isNotNull() & x["predicate"].isNotNull() & x["object"].isNotNull())
    kept = (
        df.withColumn("_bare", bare)
        .withColumn("_list", F.when(R.json_value(R.strip_json_space(F.col("_bare"))).isNotNull(), listed))
        .withColumn("status", F.when(complete, "triples").otherwise("malformed"))
        .withColumn("_list", F.when(F.col("status") == "triples", F.col("_list")))
    )
    return kept.select(*keep, "status", F.posexplode_outer("_list").alias("pos", "t")).select(
        *keep, "status", "pos",
        F.col("t.subject").alias("s"), F.col("t.predicate").alias("p"), F.col("t.object").alias("o"),
    )
