"""Prompts from templates, demonstrations and linking candidates.

A template is text with ``{slots}`` (names may hold spaces; ``{{`` and ``}}`` stand for braces).  It is
compiled once to a concatenation of literals and columns, so slot text inside the data is never filled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tripleframe.fixed import ENTITY_TYPES, RELATIONS
from tripleframe.functions.text import json_string, json_text, list_literal, strip
from tripleframe.operators import corpus
from tripleframe.operators.candidates import candidates_by_text, components
from tripleframe.operators.extract import extract_fenced_json
from tripleframe.operators.linking import describe_ids, shown_entry
from tripleframe.operators.names import best_entries, name_index, normal_name
from tripleframe.operators.retrieve import embed, mmr_examples
from tripleframe.shared import stored

STRINGS = T.ArrayType(T.StringType())


def compiled(template: str, values: Mapping[str, Column]) -> Column:
    """The template with every slot replaced by the text of its column; NULL shows as ``None``."""
    pieces: list[Column] = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if slot is not None:
            pieces.append(F.coalesce(values[slot].cast("string"), F.lit("None")))
    return F.concat(*pieces) if pieces else F.lit("")


def _columns(df: DataFrame) -> dict[str, Column]:
    return {name: F.col(f"`{name}`") for name in df.columns}


def fill_template(df: DataFrame, templates: Mapping[str, str], keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Every row filled into every template: ``keep``, ``template``, ``prompt``; one pass, no join."""
    values = _columns(df)
    filled = [F.struct(F.lit(name).alias("template"), compiled(text, values).alias("prompt")) for name, text in templates.items()]
    return df.select(*keep, F.explode(F.array(*filled)).alias("t")).select(*keep, "t.template", "t.prompt")


SHOWN_BYTES = 1 << 25  # texts of demonstrations up to this size go to every task


def few_shot_prompts(
    queries: DataFrame, demos: DataFrame, template: Mapping[str, str], key: str = "query_id", shown: DataFrame | None = None,
    widen: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Prefix, filled demonstrations in rank order, suffix, joined by newlines.

    ``queries(key, input columns)``; ``demos(key, rank, example columns)`` with a few rows per query;
    ``template`` has ``prefix``, ``formatter`` and ``suffix``.  With ``shown(id, example columns)``, ``demos(key, rank, id)`` only
    names the examples: then ids move to the queries, and the filled texts of the examples, where they are few, to all tasks.
    ``widen`` adds input columns that should not move with the keys.
    """
    widen = widen or (lambda df: df)
    values = None
    if shown is not None:
        filled = shown.select("id", compiled(template["formatter"], _columns(shown)).alias("shown"))
        # an id with several rows shows them all
        texts = stored(filled.groupBy("id").agg(F.sort_array(F.collect_list("shown")).alias("shown")), "shown")
        size = F.aggregate("shown", F.lit(0).cast("long"), lambda n, text: n + F.octet_length(text) + 32)
        if (texts.agg(F.sum(size)).first()[0] or 0) > SHOWN_BYTES:
            demos, values = demos.join(texts.withColumn("shown", F.explode("shown")), "id"), F.col("shown")
        else:
            return _with_texts(queries, demos, texts, template, key, widen)
    texts = demos.select(key, "rank", (compiled(template["formatter"], _columns(demos)) if values is None else values).alias("shown"))
    lists = texts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "shown"))).alias("_demos"))
    listed = F.transform(F.coalesce("_demos", F.array().cast("array<struct<rank:int,shown:string>>")), lambda d: d["shown"])
    return _prompted(widen(queries).join(lists, key, "left"), listed, template).drop("_demos")


def _prompted(rows: DataFrame, shown: Column, template: Mapping[str, str]) -> DataFrame:
    values = _columns(rows)
    pieces = F.concat(F.array(compiled(template["prefix"], values)), shown, F.array(compiled(template["suffix"], values)))
    return rows.withColumn("prompt", F.array_join(F.filter(pieces, lambda piece: piece != ""), "\n"))


def _with_texts(queries: DataFrame, chosen: DataFrame, texts: DataFrame, template: Mapping[str, str], key: str, widen: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Prompts of queries whose demonstrations are found by id in one small table, a join for every place."""
    lists = stored(chosen.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("_ids")), "chosen")
    places = lists.agg(F.max(F.size("_ids"))).first()[0] or 0
    rows = widen(queries.join(lists, key, "left"))
    for n in range(places):
        one = F.broadcast(texts.select(F.col("id").alias(f"_id{n}"), F.col("shown").alias(f"_shown{n}")))
        rows = rows.join(one, F.get(F.col("_ids"), F.lit(n))["id"] == F.col(f"_id{n}"), "left").drop(f"_id{n}")
    none = F.array().cast(STRINGS)
    shown = F.concat(none, *[F.coalesce(f"_shown{n}", none) for n in range(places)])
    return _prompted(rows, shown, template).drop("_ids", *[f"_shown{n}" for n in range(places)])


# ---------------------------------------------------------------- linking prompts


def described_mentions(docs: DataFrame, kb_label: DataFrame, dictionary: Sequence[corpus.Relation] = RELATIONS) -> DataFrame:
    """Distinct ``(doc_id, kind, id)`` of the documents' relations with label and description; unknown ids are left out."""
    def id_of(r: Column) -> Column:
        return corpus.relation_field(r["predicate"], "id", dictionary)

    mentioned = docs.select(
        "doc_id",
        F.explode(F.array_distinct(F.flatten(F.transform("relations", lambda x: F.array(
            F.struct(F.lit("entity").alias("kind"), x["subject"]["uri"].alias("id")),
            F.struct(F.lit("relation").alias("kind"), id_of(x).alias("id")),
            F.struct(F.lit("entity").alias("kind"), x["object"]["uri"].alias("id")),
        ))))).alias("m"),
    ).select("doc_id", "m.kind", "m.id")
    # an id with several rows in the knowledge base takes the first
    first = kb_label.groupBy("id").agg(F.min(F.struct("label", "description")).alias("d")).select("id", "d.*")
    return describe_ids(mentioned, first)


def corpus_components(docs: DataFrame, kb_label: DataFrame, dictionary: Sequence[corpus.Relation] = RELATIONS) -> DataFrame:
    """One row per entity and property of each document: ``(doc_id, kind, label, correct_answer)``, without forming linking documents."""
    return described_mentions(docs, kb_label, dictionary).select("doc_id", "kind", "label", F.col("id").alias("correct_answer"))


def linking_documents(
    docs: DataFrame, kb_label: DataFrame, types: Mapping[str, str] = ENTITY_TYPES,
    dictionary: Sequence[corpus.Relation] = RELATIONS,
) -> DataFrame:
    """Documents with typed triples and the described ids of their relations.

    ``entities`` and ``properties`` map an id to ``struct(id, label, description)``; ids the knowledge base
    does not know are left out.
    """
    r = F.col("relations")
    described = described_mentions(docs, kb_label, dictionary)
    entry = F.struct(F.col("id"), F.struct("id", "label", "description"))

    def as_map(kind: str) -> Column:
        listed = F.collect_list(F.when(F.col("kind") == kind, entry))
        return F.map_from_entries(listed)

    maps = described.groupBy("doc_id").agg(as_map("entity").alias("entities"), as_map("relation").alias("properties"))
    empty = F.create_map().cast("map<string,struct<id:string,label:string,description:string>>")
    typed = docs.select(
        "doc_id", "text", corpus.typed_triples(r, types, dictionary).alias("triples"),
        corpus.typed_id_triples(r, types, dictionary).alias("wiki_triples"),
    )
    return typed.join(maps, "doc_id", "left").withColumns(
        {c: F.coalesce(c, empty) for c in ("entities", "properties")}
    )


def document_components(linking_docs: DataFrame) -> DataFrame:
    """One row per entity and property of each document: ``(doc_id, kind, label, correct_answer)``."""
    def rows(column: str, kind: str) -> Column:
        return F.transform(
            F.map_entries(column),
            lambda e: F.struct(F.lit(kind).alias("kind"), e["value"]["label"].alias("label"), e["key"].alias("correct_answer")),
        )

    both = F.concat(rows("entities", "entity"), rows("properties", "relation"))
    return linking_docs.select("doc_id", F.explode(both).alias("c")).select("doc_id", "c.*")


KB_KIND = {"entity": "item", "relation": "property"}


def candidate_table(labels: DataFrame, kb_label: DataFrame, strategy: str = "string_search", k: int = 10) -> DataFrame:
    """``(kind, label, candidates)`` of distinct ``(kind, label)``, written once: entities by ``strategy``, relations by name.

    All names of both kinds are looked up in one sorted index and described in one join.
    """
    kind = F.when(F.col("kind") == "entity", KB_KIND["entity"]).otherwise(KB_KIND["relation"])
    named = labels.select("kind", "label", kind.alias("kb_kind"), normal_name(F.col("label")).alias("name"))
    if strategy == "page_search":
        named = named.where("kind <> 'entity'")
    elif strategy != "string_search":
        raise ValueError(f"no such strategy: {strategy}")
    best = best_entries(named.select(F.col("kb_kind").alias("kind"), "name").distinct(), name_index(kb_label), k)
    shown = describe_ids(best.select(F.col("kind").alias("kb_kind"), "name", "rank", "id"), kb_label, keep_unknown=True)
    lists = shown.groupBy("kb_kind", "name").agg(F.sort_array(F.collect_list(F.struct("rank", shown_entry().alias("entry")))).alias("c"))
    lists = lists.select("kb_kind", "name", F.col("c.entry").alias("candidates"))
    table = named.join(lists, ["kb_kind", "name"], "left").select("kind", "label", "candidates")
    if strategy == "page_search":
        entities = candidates_by_text(labels.where("kind = 'entity'").select("label"), kb_label, KB_KIND["entity"], k)
        table = table.unionByName(entities.withColumn("kind", F.lit("entity")))
    return stored(table, "candidates")


def with_candidates(
    parts: DataFrame, kb_label: DataFrame, strategy: str = "string_search", k: int = 10, texts: DataFrame | None = None
) -> DataFrame:
    """Candidates of components ``(…, kind, label)``: looked up for distinct labels, joined to the components at the end.

    ``texts(doc_id, text)`` are joined before: the candidates are the widest column and move with no other join.
    """
    parts, table = looked_up(parts, kb_label, strategy, k)
    return _widened(parts, table, texts)


def looked_up(parts: DataFrame, kb_label: DataFrame, strategy: str = "string_search", k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Components, written once, and the candidates of their distinct labels."""
    parts = stored(parts, "parts")
    return parts, candidate_table(stored(parts.select("kind", "label").distinct(), "labels"), kb_label, strategy, k)


def _widened(parts: DataFrame, table: DataFrame, texts: DataFrame | None) -> DataFrame:
    rows = parts if texts is None else parts.join(texts, "doc_id")
    return rows.join(table, ["kind", "label"], "left")


def el_demonstrations(
    docs: DataFrame, kb_label: DataFrame, strategy: str = "page_search", k: int = 10, parts: DataFrame | None = None
) -> DataFrame:
    """Demonstrations ``(doc_id, kind, text, extracted_component, candidates, correct_answer)``.

    ``docs`` are linking documents, or any documents where their ``parts`` are given (see ``corpus_components``).
    """
    texts = docs.select("doc_id", json_string(strip(F.col("text"))).alias("text"))
    parts = with_candidates(document_components(docs) if parts is None else parts, kb_label, strategy, k, texts)
    return parts.withColumnRenamed("label", "extracted_component").select(
        "doc_id", "kind", "text", "extracted_component", "candidates", "correct_answer"
    )


def el_prompts(
    docs: DataFrame, kb_label: DataFrame, template: str, strategy: str = "string_search", k: int = 10, parts: DataFrame | None = None
) -> DataFrame:
    """Linking prompts for the gold components, with the correct answer kept and a flag for missing candidates."""
    parts = el_demonstrations(docs, kb_label, strategy, k, parts)
    values = {**_columns(parts), "candidates": list_literal(F.col("candidates"))}
    return parts.select(
        "doc_id", "kind", F.col("extracted_component").alias("label"), "correct_answer",
        F.col("candidates").isNull().alias("no_candidates"), compiled(template, values).alias("prompt"),
    )


def el_prompts_few_shot(
    parts: DataFrame, demos: DataFrame, chosen: DataFrame, template: Mapping[str, str], widen: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Linking prompts with retrieved demonstrations.

    ``parts`` and ``demos`` are demonstrations with a key (``query_id`` and ``id``); ``chosen(query_id,
    rank, id)`` says which demonstrations go with which part, as ``retrieve.mmr_examples`` returns it.
    ``widen`` adds columns of ``parts`` that should not move with the keys.
    """
    shown = demos.select(
        "id", "text", json_string(strip(F.col("extracted_component"))).alias("extracted_component"),
        json_text(F.col("candidates"), STRINGS).alias("candidates"), "correct_answer",
    )

    def asked(rows: DataFrame) -> DataFrame:
        rows = widen(rows) if widen else rows
        return rows.withColumn("candidates", json_text(F.col("candidates"), STRINGS))

    filled = few_shot_prompts(parts, chosen, template, "query_id", shown, asked)
    return filled.select("doc_id", "kind", F.col("extracted_component").alias("label"), "correct_answer", "prompt")


def el_prompts_with_retrieval(
    docs: DataFrame, pool_ids: DataFrame, kb_label: DataFrame, template: Mapping[str, str], make_encoder: Callable, k: int = 1,
    strategy: str = "string_search", n_candidates: int = 10, parts: DataFrame | None = None,
) -> DataFrame:
    """Linking prompts for all components outside the pool documents ``pool_ids(doc_id)``, with ``k`` demonstrations from the pool.

    Components with the flag of the pool, candidates and vectors are each written once; texts and candidates, wide and often
    repeated, are joined where they are read, to encode and to show. Only keys and vectors are searched.
    """
    # flagged once, so that neither side repeats the choice of the pool
    pool = pool_ids.select("doc_id").distinct().withColumn("in_pool", F.lit(True))
    parts = (document_components(docs) if parts is None else parts).join(pool, "doc_id", "left").withColumn("in_pool", F.coalesce("in_pool", F.lit(False)))
    texts = docs.select("doc_id", json_string(strip(F.col("text"))).alias("text"))
    parts, table = looked_up(parts, kb_label, strategy, n_candidates)
    named = parts.withColumn("id", F.concat_ws("/", F.col("doc_id").cast("string"), "kind", "correct_answer"))

    def full(rows: DataFrame) -> DataFrame:
        return _widened(rows, table, texts).withColumnRenamed("label", "extracted_component")

    encoded = embed(full(named).withColumn("candidates_text", F.array_join("candidates", " ")), make_encoder, ["text", "extracted_component", "candidates_text"])
    vectors = stored(encoded.select("id", "in_pool", "embedding"), "vectors")
    asked = vectors.where("NOT in_pool").select(F.col("id").alias("query_id"), "embedding")
    chosen = mmr_examples(asked, vectors.where("in_pool").select("id", "embedding"), k)
    return el_prompts_few_shot(named.where("NOT in_pool").withColumnRenamed("id", "query_id"), full(named.where("in_pool")), chosen, template, full)


def el_prompts_from_extractions(
    triples: DataFrame, docs: DataFrame, kb_label: DataFrame, template: str, k: int = 10
) -> DataFrame:
    """Linking prompts for the components of extracted triples ``(run, doc_id, s, p, o)``."""
    texts = docs.select("doc_id", json_string(strip(F.col("text"))).alias("text"))
    rows = with_candidates(components(triples), kb_label, "string_search", k, texts).withColumnRenamed("label", "extracted_component")
    values = {**_columns(rows), "candidates": list_literal(F.col("candidates"))}
    return rows.select(
        "run", "doc_id", "kind", F.col("extracted_component").alias("label"),
        F.col("candidates").isNull().alias("no_candidates"), compiled(template, values).alias("prompt"),
    )


def el_prompts_from_generations(
    generations: DataFrame, docs: DataFrame, kb_label: DataFrame, template: str, text_col: str = "generated_text", k: int = 10
) -> DataFrame:
    """Linking prompts for what a generator found: answers ``(run, doc_id, text)`` that are one list of triple objects.

    An answer of another kind has no components; ``extract.extract_fenced_json`` tells which ones those are.
    """
    triples = extract_fenced_json(generations, text_col).where("status = 'triples' AND pos IS NOT NULL")
    return el_prompts_from_extractions(triples, docs, kb_label, template, k)
