"""Checks of triples against knowledge-base tables.

``kb_statement(s, p, o)`` holds the statements, ``kb_constraint(property, ctype, class_id)`` the allowed
classes of subjects (``domain``) and objects (``range``).  Everything is looked up for distinct values and
joined back; copies of a triple are counted before the first shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tripleframe.fixed import INSTANCE_OF, SUBCLASS_OF
from tripleframe.operators import extract
from tripleframe.operators.linking import distinct_labels, link_labels, link_predicates
from tripleframe.operators.names import name_index
from tripleframe.plans.ranking import spread_nulls
from tripleframe.shared import stored


def statement_exists(id_triples: DataFrame, kb_statement: DataFrame) -> DataFrame:
    """Distinct ``(s_id, p_id, o_id)`` with a flag ``statement``."""
    asked = id_triples.select("s_id", "p_id", "o_id").distinct()
    held = kb_statement.select(F.col("s").alias("s_id"), F.col("p").alias("p_id"), F.col("o").alias("o_id"))
    return asked.join(held.distinct().withColumn("_held", F.lit(True)), ["s_id", "p_id", "o_id"], "left").select(
        "s_id", "p_id", "o_id", F.coalesce("_held", F.lit(False)).alias("statement")
    )


def with_class_labels(kb_constraint: DataFrame) -> DataFrame:
    """The constraints with a ``class_label``, NULL where the table has none."""
    return kb_constraint if "class_label" in kb_constraint.columns else kb_constraint.withColumn("class_label", F.lit(None).cast("string"))


def property_constraints(kb_constraint: DataFrame) -> DataFrame:
    """Per property: its domain and range classes, their labels in the same order, and the flags whether it has them."""
    def classes(ctype: str):
        return F.sort_array(F.collect_set(F.when(F.col("ctype") == ctype, F.struct("class_id", "class_label"))))

    def part(column: str, field: str):
        return F.transform(column, lambda c: c[field])

    return (
        with_class_labels(kb_constraint).groupBy("property")
        .agg(classes("domain").alias("d"), classes("range").alias("r"))
        .select(
            "property", part("d", "class_id").alias("domain_classes"), part("r", "class_id").alias("range_classes"),
            part("d", "class_label").alias("domain_labels"), part("r", "class_label").alias("range_labels"),
        )
        .withColumns({"has_domain": F.size("domain_classes") > 0, "has_range": F.size("range_classes") > 0})
        .withColumn("has_both", F.col("has_domain") & F.col("has_range"))
    )


def constraint_flags(kb_constraint: DataFrame) -> DataFrame:
    """Per property whether it has domain and range classes."""
    return kb_constraint.groupBy("property").agg(
        F.bool_or(F.col("ctype") == "domain").alias("has_domain"), F.bool_or(F.col("ctype") == "range").alias("has_range")
    )


def _edges(kb_statement: DataFrame, prop: str) -> DataFrame:
    chosen = kb_statement.where(F.col("p") == prop)
    return chosen.select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct()


def class_closure(classes: DataFrame, kb_statement: DataFrame, full_chain: bool = True) -> DataFrame:
    """Distinct ``(class0, hop, class_id)`` for hops 0 to 3 above the given ``classes(class0)``.

    With ``full_chain`` only chains of three subclass edges count, each for all its four classes.  A hop reads only the
    edges above the classes the last one reached; the edges taken are written, so classes nobody asks for are
    dropped by the first join and chains are checked on the reached part of the graph alone.
    """
    edges = _edges(kb_statement, SUBCLASS_OF)
    pairs = [classes.select("class0", F.col("class0").alias("class_id")).distinct()]
    frontier, steps = pairs[0].select("class_id"), []
    for n in (1, 2, 3):
        steps.append(stored(edges.join(frontier, F.col("child") == F.col("class_id"), "left_semi"), f"hop-{n}"))
        frontier = steps[-1].select(F.col("parent").alias("class_id")).distinct()
    for n, step in enumerate(steps):
        above = pairs[n].join(step.withColumnRenamed("child", "class_id"), "class_id")
        pairs.append(above.select("class0", F.col("parent").alias("class_id")).distinct())
    if full_chain:
        # what is on a chain: at hop 2 the classes with an edge, below them those with an edge to such a class
        goes_on = steps[2].select("child")
        for n in (2, 1, 0):
            pairs[n] = pairs[n].join(goes_on, F.col("class_id") == F.col("child"), "left_semi")
            if n:
                goes_on = steps[n - 1].join(goes_on.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child")
    closure = pairs[0].withColumn("hop", F.lit(0))
    for n in (1, 2, 3):
        closure = closure.unionByName(pairs[n].withColumn("hop", F.lit(n)))
    return closure.select("class0", "hop", "class_id")


def _classes_by_id(ids: DataFrame, kb_statement: DataFrame, firsts: Sequence[str]) -> DataFrame:
    """``(id, classes)``: the sorted first classes of every id asked for that has some, written once."""
    chosen = kb_statement.where(F.col("p").isin(*firsts) & F.col("o").isNotNull()).select(F.col("s").alias("id"), F.col("o").alias("class0"))
    asked = chosen.join(ids.select("id").distinct(), "id", "left_semi")
    return stored(asked.groupBy("id").agg(F.sort_array(F.collect_set("class0")).alias("classes")), "first-classes")


def type_closure(
    ids: DataFrame, kb_statement: DataFrame, first: str | Sequence[str] = INSTANCE_OF, full_chain: bool = True
) -> DataFrame:
    """Distinct ``(id, hop, class_id)``: classes reached by one ``first`` edge and up to three subclass edges.

    By default an id counts only along chains with all three subclass edges; ``full_chain=False`` takes
    shorter ones too.  The class graph is followed from the classes of the ids, once per class.
    """
    by_id = _classes_by_id(ids, kb_statement, [first] if isinstance(first, str) else list(first))
    return _along(by_id, class_closure(_listed_classes(by_id), kb_statement, full_chain))


def _listed_classes(by_id: DataFrame) -> DataFrame:
    """Distinct ``class0`` of ``by_id(id, classes)``."""
    return by_id.select("classes").distinct().select(F.explode("classes").alias("class0")).distinct()


def _along(by_id: DataFrame, closure: DataFrame) -> DataFrame:
    """Distinct ``(id, hop, class_id)`` of ``by_id(id, classes)``.

    Ids mostly share their classes, so a class reached twice is told once per set of classes: no row of an id needs
    to be compared with another.
    """
    sets = by_id.select("classes").distinct().select("classes", F.explode("classes").alias("class0"))
    reached = sets.join(closure, "class0").where(F.col("class_id").isNotNull()).select("classes", "hop", "class_id").distinct()
    return by_id.join(reached, "classes").select("id", "hop", "class_id")


def merge_types(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two closures."""
    # dealt by id first: rows found in one place only gain nothing from a table of them in the task that made them
    return first.unionByName(second).repartition("id").distinct()


def all_types(ids: DataFrame, kb_statement: DataFrame, full_chain: bool = True) -> DataFrame:
    """Classes of ids by either kind of first edge: the merged closures, found in one pass."""
    return type_closure(ids, kb_statement, (INSTANCE_OF, SUBCLASS_OF), full_chain)


def match_types(pairs: DataFrame, types: DataFrame, kb_constraint: DataFrame, ctype: str) -> DataFrame:
    """For ``(id, property)`` pairs the lowest hop at which the id has an allowed class, with that class and its label.

    Pairs without a match are left out.  Among classes of the same hop the smallest id is shown.
    """
    allowed = with_class_labels(kb_constraint).where(F.col("ctype") == ctype).groupBy("property", "class_id").agg(F.min("class_label").alias("class_label"))
    asked = pairs.select("id", "property").distinct().join(allowed.select("property").distinct(), "property", "left_semi")
    # a type that no constraint names fits nothing: it goes before it meets the pairs
    fitting = types.join(allowed.select("class_id").distinct(), "class_id", "left_semi")
    return (
        asked.join(fitting, "id")
        .join(allowed, ["property", "class_id"])
        .groupBy("id", "property")
        .agg(F.min(F.struct("hop", "class_id", "class_label")).alias("m"))
        .select("id", "property", F.col("m.hop").alias("level"), F.col("m.class_id").alias("class_id"), "m.class_label")
    )


def _allowed(kb_constraint: DataFrame) -> DataFrame:
    """Distinct ``(property, ctype, class_id)`` with the smallest class label."""
    return with_class_labels(kb_constraint).groupBy("property", "ctype", "class_id").agg(F.min("class_label").alias("class_label"))


def class_fits(
    classes: DataFrame, kb_statement: DataFrame, kb_constraint: DataFrame, full_chain: bool = True, properties: DataFrame | None = None
) -> DataFrame:
    """``(class0, ctype, property, fit)``: lowest hop, with the class and its label, at which things of a class meet a constraint.

    Follows the class graph from ``classes(class0)``; with ``properties(property)`` the constraints of these only.
    """
    allowed = _allowed(kb_constraint)
    if properties is not None:
        allowed = allowed.join(properties, "property", "left_semi")
    return (
        class_closure(classes, kb_statement, full_chain)
        .join(allowed, "class_id")
        .groupBy("class0", "ctype", "property")
        .agg(F.min(F.struct("hop", "class_id", "class_label")).alias("fit"))
    )


def _stated(asked: DataFrame, kb_statement: DataFrame) -> DataFrame:
    """Those of the distinct ``asked(s_id, p_id, o_id)`` that the knowledge base states.

    ``asked`` is written first, so its size is known: if it is small, statements nobody asks for end where they are read.
    """
    held = kb_statement.select(F.col("s").alias("s_id"), F.col("p").alias("p_id"), F.col("o").alias("o_id"))
    return held.join(stored(asked, "asked"), ["s_id", "p_id", "o_id"], "left_semi").distinct()


def _set_fits(linked: DataFrame, fits: DataFrame) -> DataFrame:
    """``(classes, ctype, property, fit)``: lowest fit of every set of classes that an end of a linked triple has with its property."""
    end = F.explode(F.array(*[
        F.struct(F.lit(ctype).alias("ctype"), F.col(classes).alias("classes")) for ctype, classes in (("domain", "s_classes"), ("range", "o_classes"))
    ]))
    asked = linked.select(F.col("p_id").alias("property"), end.alias("end")).select("property", "end.*").where(
        F.col("property").isNotNull() & F.col("classes").isNotNull()
    ).distinct()
    return (
        asked.withColumn("class0", F.explode("classes"))
        .join(fits, ["class0", "ctype", "property"])
        .groupBy("classes", "ctype", "property")
        .agg(F.min("fit").alias("fit"))
    )


def check_distinct(
    triples: DataFrame, kb_label: DataFrame, kb_statement: DataFrame, kb_constraint: DataFrame, full_chain: bool = True
) -> DataFrame:
    """Checks of rows ``(…, s, p, o)`` whose texts hardly repeat, every row with all its columns; see ``check_triples`` for the checks.

    Links, flags and first classes go to the distinct labels, so that three joins bring all of them to a triple.  Types are
    matched per set of classes and property, statements looked up per distinct ids; these three joins end the line.
    No row is multiplied or folded.
    """
    given = triples.columns
    triples = stored(triples, "triples")
    index = name_index(kb_label)
    entities = stored(link_labels(distinct_labels(triples, "s", "o"), kb_label, "item", False, index).select("label", "id"), "entities")
    allowed = stored(_allowed(kb_constraint), "constraints")
    predicates = link_predicates(distinct_labels(triples, "p"), kb_label, False, index).select(
        F.col("label").alias("p"), F.col("direct_id").alias("p_direct_id"), F.col("id").alias("p_id")
    )
    predicates = stored(predicates.join(constraint_flags(allowed).withColumnRenamed("property", "p_id"), "p_id", "left"), "predicates")
    by_id = _classes_by_id(entities, kb_statement, (INSTANCE_OF, SUBCLASS_OF))
    ends = entities.join(by_id, "id", "left")
    linked = stored(
        triples.join(ends.withColumnsRenamed({"label": "s", "id": "s_id", "classes": "s_classes"}), "s", "left")
        .join(ends.withColumnsRenamed({"label": "o", "id": "o_id", "classes": "o_classes"}), "o", "left")
        .join(predicates, "p", "left"),
        "linked",
    )
    p_known, s_known, o_known = (F.col(c).isNotNull() for c in ("p_id", "s_id", "o_id"))
    complete = s_known & p_known & o_known
    stated = _stated(linked.where(complete).select("s_id", "p_id", "o_id").distinct(), kb_statement)

    asked = predicates.select(F.col("p_id").alias("property")).distinct()
    fits = stored(_set_fits(linked, class_fits(_listed_classes(by_id), kb_statement, allowed, full_chain, asked)), "fits")

    def fit(ctype: str, end: str) -> DataFrame:
        return fits.where(F.col("ctype") == ctype).select(F.col("classes").alias(f"{end}_set"), F.col("property").alias("p_key"), F.col("fit").alias(ctype))

    joined = (
        linked.withColumns(
            {
                "p_key": spread_nulls(F.col("p_id"), "s", "p", "o"), "s_key": spread_nulls(F.col("s_id"), "s", "p", "o"),
                **{f"{end}_set": F.coalesce(f"{end}_classes", F.array(spread_nulls(F.lit(None).cast("string"), "s", "p", "o"))) for end in ("s", "o")},
            }
        )
        .join(fit("domain", "s"), ["s_set", "p_key"], "left")
        .join(fit("range", "o"), ["o_set", "p_key"], "left")
        .join(stated.select(F.col("s_id").alias("s_key"), F.col("p_id").alias("p_key"), "o_id", F.lit(True).alias("held")), ["s_key", "p_key", "o_id"], "left")
    )
    has_domain, has_range = (F.coalesce(c, F.lit(False)) for c in ("has_domain", "has_range"))
    facts = joined.select(
        *given, "s_id", "p_direct_id", "p_id", "o_id", complete.alias("all_linked"),
        has_domain.alias("has_domain"), has_range.alias("has_range"),
        F.when(p_known, has_domain & has_range).alias("has_both"),
        F.when(p_known & s_known, F.col("domain").isNotNull()).alias("domain_match"),
        F.col("domain.hop").alias("domain_level"), F.col("domain.class_id").alias("domain_class"),
        F.col("domain.class_label").alias("domain_label"),
        F.when(p_known & o_known, F.col("range").isNotNull()).alias("range_match"),
        F.col("range.hop").alias("range_level"), F.col("range.class_id").alias("range_class"),
        F.col("range.class_label").alias("range_label"),
        F.when(complete, F.coalesce("held", F.lit(False))).alias("statement"),
    )
    no = F.lit(False)
    fitting = F.col("has_both") & F.col("domain_match") & F.col("range_match")
    flagged = facts.withColumns(
        {
            "object_missing": F.coalesce(F.col("has_both") & s_known & ~o_known, no),
            "subject_missing": F.coalesce(F.col("has_both") & o_known & ~s_known, no),
            "both_missing": F.coalesce(F.col("has_both") & ~s_known & ~o_known, no),
            "type_match": F.when(F.col("all_linked"), fitting),
            "level": F.when(F.col("all_linked") & fitting, F.greatest("domain_level", "range_level")),
        }
    )
    return flagged.withColumn("statement_and_match", F.coalesce(F.col("type_match") & F.col("statement"), no)).select(
        *given, *CHECK_COLUMNS
    )


CHECK_COLUMNS = [
    "s_id", "p_direct_id", "p_id", "o_id", "all_linked", "has_domain", "has_range", "has_both",
    "domain_match", "domain_level", "domain_class", "domain_label",
    "range_match", "range_level", "range_class", "range_label",
    "object_missing", "subject_missing", "both_missing", "statement", "type_match", "level", "statement_and_match",
]


def check_triples(
    triples: DataFrame, kb_label: DataFrame, kb_statement: DataFrame, kb_constraint: DataFrame,
    full_chain: bool = True, copies: bool = True,
) -> DataFrame:
    """Every triple ``(…, s, p, o)`` with its links and checks.

    ``s_id``, ``p_id``, ``o_id`` are the linked ids (``p_direct_id``: before function words were dropped).
    ``has_domain/has_range/has_both`` tell which constraints the property has; ``domain_match`` and
    ``range_match`` with level (0 to 3), class and class label whether the types fit; ``type_match`` whether all fits,
    at ``level``; ``statement`` whether the knowledge base states the triple.  A NULL part links to nothing; the
    other parts of such a triple are checked all the same.  Texts are checked once and joined back to their copies;
    ``copies=False`` leaves that out for triples that hardly repeat, with the same result.
    """
    if not copies:
        return check_distinct(triples, kb_label, kb_statement, kb_constraint, full_chain)
    checked = check_distinct(
        triples.select("s", "p", "o").distinct(), kb_label, kb_statement, kb_constraint, full_chain
    )
    return _with_checks(triples, checked)


def _with_checks(triples: DataFrame, checked: DataFrame) -> DataFrame:
    """The triples with the checks of their texts; NULL parts meet NULL parts."""
    keys = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("s", "p", "o")]
    return triples.join(checked.withColumnsRenamed({c: f"_{c}" for c in ("s", "p", "o")}), keys, "left").drop("_s", "_p", "_o")


def check_counted(
    triples: DataFrame, kb_label: DataFrame, kb_statement: DataFrame, kb_constraint: DataFrame, full_chain: bool = True
) -> DataFrame:
    """Distinct triples ``(run, s, p, o)`` with ``copies`` and the checks: what the counters need of any number of copies."""
    return check_distinct(counted_triples(triples), kb_label, kb_statement, kb_constraint, full_chain)


def counted_triples(triples: DataFrame) -> DataFrame:
    """Distinct ``(run, s, p, o)`` with ``copies``."""
    return triples.groupBy("run", "s", "p", "o").agg(F.count(F.lit(1)).alias("copies"))


def kb_summary(checked: DataFrame, malformed: DataFrame | None = None) -> DataFrame:
    """Counters per run over every triple; a ``copies`` column counts a row that often.

    ``malformed(run, malformed)`` adds the items that were no triples.
    """
    weight = F.col("copies") if "copies" in checked.columns else F.lit(1)

    def total(condition) -> object:
        return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("bigint")

    c = F.col
    at_level = {f"hop_{n}": total(c("level") == n) for n in range(4)}
    counters = {
        "triples": F.sum(weight).cast("bigint"),
        "has_domain_range": total(c("has_both")),
        "domain_range_match": total(c("type_match")),
        **at_level,
        "only_subject": total(c("object_missing")),
        "only_subject_match": total(c("object_missing") & c("domain_match")),
        "only_object": total(c("subject_missing")),
        "only_object_match": total(c("subject_missing") & c("range_match")),
        "neither": total(c("both_missing")),
        "both_linked": total(c("all_linked") & c("has_both")),
        "all_linked": total(c("all_linked")),
        "statement": total(c("statement")),
        "statement_and_match": total(c("statement_and_match")),
    }
    summary = checked.groupBy("run").agg(*[value.alias(name) for name, value in counters.items()])
    if malformed is None:
        return summary.withColumn("malformed", F.lit(0).cast("bigint"))
    both = summary.join(malformed.select("run", "malformed"), "run", "full").na.fill(0)
    return both.withColumn("triples", c("triples") + c("malformed"))


def summarize_texts(
    texts: DataFrame, kb_label: DataFrame, kb_statement: DataFrame, kb_constraint: DataFrame,
    text_col: str = "generated_text", full_chain: bool = True,
) -> DataFrame:
    """From generated texts ``(run, doc_id, text)`` to all counters per run: readers, malformed items, checks."""
    items = extract.extract_triples(texts, text_col, capitals=False)
    valid, _ = extract.split_valid(items)
    checked = check_counted(valid.select("run", "s", "p", "o"), kb_label, kb_statement, kb_constraint, full_chain)
    return kb_summary(checked, extract.malformed_counts(items))


def hop_histogram(checked: DataFrame) -> DataFrame:
    """Matching triples by level, per run."""
    weight = F.col("copies") if "copies" in checked.columns else F.lit(1)
    counts = [F.coalesce(F.sum(F.when(F.col("level") == n, weight)), F.lit(0)).cast("bigint").alias(f"hop_{n}") for n in range(4)]
    return checked.groupBy("run").agg(*counts)


def latest_by_triple(checked: DataFrame, order: Sequence[str] = ("doc_id", "pos")) -> DataFrame:
    """The last record of every ``(run, s, p, o)``."""
    rest = [c for c in checked.columns if c not in ("run", "s", "p", "o", *order)]
    last = F.max(F.struct(*order, *rest)).alias("last")
    return checked.groupBy("run", "s", "p", "o").agg(last).select("run", "s", "p", "o", "last.*")


def constraint_coverage(mentions: DataFrame, kb_constraint: DataFrame) -> DataFrame:
    """Per run, linked relation mentions whose property has domain, range and both; ordered by run."""
    linked = mentions.where((F.col("kind") == "relation") & F.col("id").isNotNull())
    flags = constraint_flags(kb_constraint).withColumnRenamed("property", "id")
    return (
        linked.join(flags, "id", "left")
        .groupBy("run")
        .agg(
            F.count_if("has_domain").alias("with_domain"), F.count_if("has_range").alias("with_range"),
            F.count_if(F.col("has_domain") & F.col("has_range")).alias("with_both"),
        )
        .orderBy("run")
    )
