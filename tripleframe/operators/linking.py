"""Labels to knowledge-base ids.

``kb_label`` has one row ``(id, kind, label, aliases, description, popularity)`` per entry; ``aliases`` may
be missing.  Names are compared trimmed and in lower case.  The best entry of a label is the one with the
smallest (match class, minus popularity, id), where the class is 1 for the label itself, 2 for an alias
and 3 for a longer name that starts with the label.

Only distinct labels are linked, by search in a sorted index of the names (see ``names``).  The index may be built once and
passed to any number of calls; otherwise each call builds its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripleframe.fixed import NO_DESCRIPTION, NO_LABEL, PREDICATE_PREFIXES
from tripleframe.operators.names import NameIndex, best_entries, name_index, normal_name
from tripleframe.shared import stored


def distinct_labels(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct non-NULL values of the columns as ``label``; one pass, copies go before the shuffle."""
    labels = df.select(F.explode(F.array(*columns)).alias("label"))
    return labels.where(F.col("label").isNotNull()).distinct()


def index_of(kb_label: DataFrame, kind: str, index: NameIndex | None) -> NameIndex:
    return index or name_index(kb_label.where(F.col("kind") == kind))


def link_labels(
    labels: DataFrame, kb_label: DataFrame, kind: str = "item", keep_unlinked: bool = True, index: NameIndex | None = None
) -> DataFrame:
    """Best id of every distinct label: ``(label, id, match_class)``, NULL where nothing matches.

    ``keep_unlinked=False`` leaves labels without a match out, for callers that join the links to their
    own rows anyway.
    """
    named = stored(labels.select("label").distinct().select("label", normal_name(F.col("label")).alias("name")), "labels")
    best = best_entries(named.select(F.lit(kind).alias("kind"), "name").distinct(), index_of(kb_label, kind, index), 1)
    links = named.join(best.select("name", "id", "match_class"), "name", "left" if keep_unlinked else "inner")
    return links.select("label", "id", "match_class")


def strip_function_words(label: Column) -> Column:
    """Text after the last occurrence of the last listed function-word prefix the label starts with; else NULL."""
    words = F.array(*[F.lit(word) for word in PREDICATE_PREFIXES])
    hit = F.try_element_at(F.filter(words, lambda word: F.startswith(label, word)), F.lit(-1))
    pieces = F.split(label, F.concat(F.lit("\\Q"), hit, F.lit("\\E")), -1)
    return F.when(hit.isNotNull(), F.try_element_at(pieces, F.lit(-1)))


def link_predicates(
    labels: DataFrame, kb_label: DataFrame, keep_unlinked: bool = True, index: NameIndex | None = None
) -> DataFrame:
    """Property of every distinct predicate: ``(label, direct_id, stripped, id)``.

    ``direct_id`` is the link of the predicate as it stands; where there is none, ``id`` is the link of the
    predicate without its leading function words.  Both names are looked up together.
    """
    cut = strip_function_words(F.col("label"))
    named = labels.select("label").distinct().select("label", cut.alias("cut"), normal_name(F.col("label")).alias("name"), normal_name(cut).alias("cut_name"))
    named = stored(named, "predicates")
    texts = named.select(F.lit("property").alias("kind"), F.explode(F.array("name", "cut_name")).alias("name")).distinct()
    best = stored(best_entries(texts, index_of(kb_label, "property", index), 1).select("name", "id"), "links")
    links = named.join(best.withColumnRenamed("id", "direct_id"), "name", "left").join(
        best.withColumnsRenamed({"id": "cut_id", "name": "cut_name"}), "cut_name", "left"
    )
    found = links.select(
        "label", "direct_id", F.when(F.col("direct_id").isNull(), F.col("cut")).alias("stripped"), F.coalesce("direct_id", "cut_id").alias("id")
    )
    return found if keep_unlinked else found.where(F.col("id").isNotNull())


def describe_ids(ids: DataFrame, kb_label: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Label and description of the ``id`` column, with stand-in texts where one is missing.

    Unknown ids are dropped, or kept with both stand-ins when ``keep_unknown``.
    """
    known = kb_label.select("id", "label", "description")
    return ids.join(known, "id", "left" if keep_unknown else "inner").withColumns(
        {
            "label": F.coalesce("label", F.lit(NO_LABEL)),
            "description": F.coalesce("description", F.lit(NO_DESCRIPTION)),
        }
    )


def shown_entry() -> Column:
    """``<id> (<label>): <description>``."""
    return F.concat(F.col("id"), F.lit(" ("), F.col("label"), F.lit("): "), F.col("description"))


# ---------------------------------------------------------------- statistics


def distinct_mentions(checked: DataFrame) -> DataFrame:
    """Distinct ``(run, kind, label, id)`` of checked triples: predicates with their direct link, subjects and objects with theirs."""
    def part(kind: str, label: str, id_col: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(label).alias("label"), F.col(id_col).alias("id"))

    parts = F.array(part("relation", "p", "p_direct_id"), part("entity", "s", "s_id"), part("entity", "o", "o_id"))
    return checked.select("run", F.explode(parts).alias("m")).select("run", "m.*").distinct()


def mentions(triples: DataFrame, kb_label: DataFrame) -> DataFrame:
    """The same from triples ``(run, s, p, o)`` that need no other check: one pass over them, then the links of distinct labels."""
    def part(kind: str, label: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(label).alias("label"))

    seen = triples.select("run", F.explode(F.array(part("relation", "p"), part("entity", "s"), part("entity", "o"))).alias("m"))
    distinct = stored(seen.select("run", "m.kind", "m.label").distinct(), "mentions")
    of = lambda kind: distinct.where((F.col("kind") == kind) & F.col("label").isNotNull()).select("label").distinct()
    index = name_index(kb_label)
    entities = link_labels(of("entity"), kb_label, "item", False, index).select(F.lit("entity").alias("kind"), "label", "id")
    relations = link_labels(of("relation"), kb_label, "property", False, index).select(F.lit("relation").alias("kind"), "label", "id")
    return distinct.join(entities.unionByName(relations), ["kind", "label"], "left").select("run", "kind", "label", "id")


def linking_stats(mentions: DataFrame) -> DataFrame:
    """Per run and kind: all, linked and unlinked mentions, ordered by kind and run."""
    linked = F.col("id").isNotNull()
    return (
        mentions.groupBy("kind", "run")
        .agg(
            F.count(F.lit(1)).alias("all_mentions"), F.count_if(linked).alias("linked"),
            F.count_if(~linked).alias("not_linked"),
        )
        .orderBy("kind", "run")
    )


def order_results(results: DataFrame) -> DataFrame:
    """Results in run order."""
    return results.orderBy("run")
