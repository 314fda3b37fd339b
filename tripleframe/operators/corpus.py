"""Annotated documents to training and test records.

A document is one row ``(doc_id, text, entities, relations)`` with the annotations as arrays, so all of
this is projection: no shuffle, no join.  The two dictionaries are fixed small maps inside the plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from tripleframe.fixed import ENTITY_TYPES, RELATIONS
from tripleframe.functions.text import let, sentence_case

Relation = tuple[str, int, str]


def _map(pairs: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


# ---------------------------------------------------------------- dictionaries


def type_name(code: Column, types: Mapping[str, str] = ENTITY_TYPES, on_missing: str = "error") -> Column:
    """Long name of a type code; an unknown code is an error, or NULL with ``on_missing='null'``."""
    name = F.try_element_at(_map(types), code)
    if on_missing == "null":
        return name
    return F.coalesce(name, F.raise_error(F.concat(F.lit("unknown entity type: "), F.coalesce(code, F.lit("NULL")))).cast("string"))


def relation_field(number: Column, field: str = "name", relations: Sequence[Relation] = RELATIONS) -> Column:
    """Name or property id (``field='id'``) of a predicate number; NULL when the number is unknown."""
    position = {"name": 0, "id": 2}[field]
    return F.try_element_at(_map({r[1]: r[position] for r in relations}), number.cast("int"))


def lookup_type(df: DataFrame, column: str, out: str, types: Mapping[str, str] = ENTITY_TYPES, on_missing: str = "error") -> DataFrame:
    return df.withColumn(out, type_name(F.col(column), types, on_missing))


def lookup_relation(df: DataFrame, column: str, out: str, field: str = "name", relations: Sequence[Relation] = RELATIONS) -> DataFrame:
    return df.withColumn(out, relation_field(F.col(column), field, relations))


# ---------------------------------------------------------------- entities


def distinct_entities(entities: Column) -> Column:
    """Surface forms in order of first mention, each once."""
    return F.array_distinct(F.transform(entities, lambda e: e["surfaceform"]))


def _first_mentions(entities: Column) -> Column:
    """The first mention of every surface form, in document order: sort, keep group heads, sort back."""
    by_form = F.sort_array(
        F.transform(entities, lambda e, i: F.struct(e["surfaceform"].alias("form"), i.alias("pos"), e["type"].alias("type"), e["uri"].alias("uri")))
    )
    heads = let(
        by_form,
        lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["form"] != x["form"])),
    )
    return F.sort_array(F.transform(heads, lambda x: F.struct(x["pos"], x["form"], x["type"], x["uri"])))


def _described(entities: Column) -> Column:
    """First mentions that get a sentence: neither empty nor starting with an upper-case letter."""
    return F.filter(_first_mentions(entities), lambda x: (x["form"] != "") & ~x["form"].rlike(r"^\p{Lu}"))


def entity_type_facts(entities: Column, types: Mapping[str, str] = ENTITY_TYPES) -> Column:
    """``<Form> is a/an <type>.``"""
    return F.transform(
        _described(entities),
        lambda x: F.concat(sentence_case(x["form"]), F.lit(" is a/an "), F.lower(type_name(x["type"], types)), F.lit(".")),
    )


def entity_id_facts(entities: Column) -> Column:
    """``<Form> has a Wikidata ID of <id>.``"""
    return F.transform(
        _described(entities), lambda x: F.concat(sentence_case(x["form"]), F.lit(" has a Wikidata ID of "), x["uri"], F.lit("."))
    )


# ---------------------------------------------------------------- relations


def _numbers(relations: Column) -> Column:
    return F.transform(relations, lambda r: r["predicate"].cast("int"))


def relation_list(relations: Column, dictionary: Sequence[Relation] = RELATIONS) -> Column:
    """Predicate names in order of first use, each once."""
    return F.array_distinct(F.transform(_numbers(relations), lambda n: relation_field(n, "name", dictionary)))


def relation_id_facts(relations: Column, dictionary: Sequence[Relation] = RELATIONS) -> Column:
    """``<Predicate> has the Wikidata ID of <id>.`` for every predicate used."""
    return F.transform(
        F.array_distinct(_numbers(relations)),
        lambda n: F.concat(
            sentence_case(relation_field(n, "name", dictionary)), F.lit(" has the Wikidata ID of "),
            relation_field(n, "id", dictionary), F.lit("."),
        ),
    )


def _triple(s: Column, p: Column, o: Column) -> Column:
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"))


def gold_string_triples(relations: Column, dictionary: Sequence[Relation] = RELATIONS) -> Column:
    """Distinct (subject form, predicate, object form); a predicate's first triple has it capitalised."""

    def build(numbers: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            name = relation_field(r["predicate"], "name", dictionary)
            first = F.array_position(numbers, r["predicate"].cast("int")) == i + 1
            shown = F.when(first, sentence_case(name)).otherwise(name)
            return _triple(r["subject"]["surfaceform"], shown, r["object"]["surfaceform"])

        return F.array_distinct(F.transform(relations, one))

    return let(_numbers(relations), build)


def gold_id_triples(relations: Column, dictionary: Sequence[Relation] = RELATIONS) -> Column:
    """Distinct (subject id, property id, object id)."""
    return F.array_distinct(
        F.transform(relations, lambda r: _triple(r["subject"]["uri"], relation_field(r["predicate"], "id", dictionary), r["object"]["uri"]))
    )


def typed_triples(relations: Column, types: Mapping[str, str] = ENTITY_TYPES, dictionary: Sequence[Relation] = RELATIONS) -> Column:
    """Per relation: both forms with their long type names, and the predicate; copies kept."""
    return F.transform(
        relations,
        lambda r: F.struct(
            r["subject"]["surfaceform"].alias("subject"), type_name(r["subject"]["type"], types).alias("subject_type"),
            relation_field(r["predicate"], "name", dictionary).alias("predicate"),
            r["object"]["surfaceform"].alias("object"), type_name(r["object"]["type"], types).alias("object_type"),
        ),
    )


def typed_id_triples(relations: Column, types: Mapping[str, str] = ENTITY_TYPES, dictionary: Sequence[Relation] = RELATIONS) -> Column:
    """As ``typed_triples``, with the three ids."""
    return F.transform(
        relations,
        lambda r: F.struct(
            r["subject"]["surfaceform"].alias("subject"), type_name(r["subject"]["type"], types).alias("subject_type"),
            r["subject"]["uri"].alias("subject_wikiID"),
            relation_field(r["predicate"], "name", dictionary).alias("predicate"),
            relation_field(r["predicate"], "id", dictionary).alias("predicate_wikiID"),
            r["object"]["surfaceform"].alias("object"), type_name(r["object"]["type"], types).alias("object_type"),
            r["object"]["uri"].alias("object_wikiID"),
        ),
    )


# ---------------------------------------------------------------- corrupted and mixed triples


def _draw(seed: int | str, doc: Column, draw: Column, slot: int, size: Column) -> Column:
    """A position below ``size`` from 32 bits of a hash of (seed, document, draw number)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), doc.cast("string"), F.lit(":"), draw.cast("string")))
    number = F.conv(F.substring(digest, 8 * slot + 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, size).cast("int")


def corrupt_triples(doc: Column, entities: Column, names: Column, triples: Column, k: int = 2, seed: int | str = 13) -> Column:
    """``k`` draws of (entity, predicate, entity), kept where the document does not state the triple.

    ``entities`` and ``names`` are the distinct lists of the document, ``triples`` its true triples; the
    comparison ignores case.  A document without entities or relations gives an empty list.
    """

    def one(i: Column) -> Column:
        at = lambda items, slot: F.get(items, _draw(seed, doc, i, slot, F.size(items)))
        return _triple(at(entities, 0), at(names, 1), at(entities, 2))

    true = F.transform(triples, lambda t: F.concat_ws("\n", F.lower(t["s"]), F.lower(t["p"]), F.lower(t["o"])))
    drawn = F.transform(F.sequence(F.lit(1), F.lit(k)), one)
    kept = F.filter(
        drawn, lambda t: ~F.array_contains(true, F.concat_ws("\n", F.lower(t["s"]), F.lower(t["p"]), F.lower(t["o"])))
    )
    possible = (F.size(entities) > 0) & (F.size(names) > 0)
    return F.when(possible, kept).otherwise(F.array().cast("array<struct<s:string,p:string,o:string>>"))


def explanations(corrupted: Column) -> Column:
    """A sentence per corrupted triple, each once."""
    return F.array_distinct(
        F.transform(
            corrupted,
            lambda t: F.concat(
                F.lit("The relation - "), t["p"], F.lit(" - does not hold between "), t["s"], F.lit(" and "), t["o"], F.lit(".")
            ),
        )
    )


def mix_triples(doc: Column, triples: Column, corrupted: Column, seed: int | str = 13) -> Column:
    """True and corrupted triples together, in an order drawn from the seed."""
    def keyed(t: Column, i: Column) -> Column:
        text = F.concat(F.lit(f"{seed}:"), doc.cast("string"), F.lit(":"), t["s"], F.lit(":"), t["p"], F.lit(":"), t["o"])
        return F.struct(F.md5(text).alias("h"), i.alias("i"), t.alias("t"))

    return F.transform(F.sort_array(F.transform(F.concat(triples, corrupted), keyed)), lambda x: x["t"])


# ---------------------------------------------------------------- whole records


def convert_documents(
    docs: DataFrame, seed: int | str = 13, k: int = 2,
    types: Mapping[str, str] = ENTITY_TYPES, dictionary: Sequence[Relation] = RELATIONS,
) -> DataFrame:
    """Training records: all derived lists of every document, one row per document."""
    e, r = F.col("entities"), F.col("relations")
    carried = [c for c in ("doc_id", "split") if c in docs.columns]
    # plain names first: columns that differ from an input only in case would hide it from later ones
    lists = docs.select(
        *carried, F.col("text").alias("_text"),
        distinct_entities(e).alias("_ents"),
        entity_type_facts(e, types).alias("_type_facts"),
        entity_id_facts(e).alias("_id_facts"),
        relation_list(r, dictionary).alias("_names"),
        relation_id_facts(r, dictionary).alias("_name_facts"),
        gold_string_triples(r, dictionary).alias("_true"),
        gold_id_triples(r, dictionary).alias("_true_ids"),
    )
    doc, true = F.col("doc_id"), F.col("_true")
    made = lists.withColumn("_made", corrupt_triples(doc, F.col("_ents"), F.col("_names"), true, k, seed))
    return made.select(
        *carried, F.col("_text").alias("Text"), F.col("_ents").alias("Entities"), F.col("_type_facts").alias("Entity Types"),
        F.col("_id_facts").alias("Entity wiki ids"), F.col("_names").alias("Relations"),
        F.col("_name_facts").alias("Relation wiki ids"), true.alias("Triples"), F.col("_true_ids").alias("Wiki Triples"),
        mix_triples(doc, true, F.col("_made"), seed).alias("Mixed Triples"), F.col("_made").alias("Corrupted Triples"),
        explanations(F.col("_made")).alias("Explanations"),
    )


def split_counts(docs: DataFrame) -> DataFrame:
    """Documents per split."""
    return docs.groupBy("split").agg(F.count(F.lit(1)).alias("documents"))
