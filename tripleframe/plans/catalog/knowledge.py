"""Queries of linking, candidates and knowledge-base checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleframe.fixed import PREDICATE_PREFIXES
from tripleframe.operators import candidates, kb, linking
from tripleframe.plans.catalog.registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql


def kb_label(spark):
    """The label view with its aliases as arrays."""
    aliases = spark.table("fx_kb_alias").groupBy("id").agg(F.collect_set("alias").alias("aliases"))
    return spark.table("fx_kb_label").join(aliases, "id", "left")


# Best entry per label: exact label, then alias, then longer label; then popularity and id.
_LINK = """
names AS (SELECT id, kind, lower(trim(label)) AS name, 1 AS c, popularity FROM fx_kb_label
  UNION ALL SELECT a.id, k.kind, lower(trim(a.alias)), 2, k.popularity FROM fx_kb_alias a JOIN fx_kb_label k ON k.id = a.id),
labels AS (SELECT DISTINCT 'item' AS kind, unnest([s, o]) AS label FROM fx_pred
  UNION SELECT DISTINCT 'item', replace(s, '#', ' no ') FROM fx_pred
  UNION SELECT DISTINCT 'property', p FROM fx_pred UNION SELECT 'property', 'was a manufacturer of' UNION SELECT 'property', 'supp'),
best AS (SELECT l.kind, l.label, min_by(n.id, row(CASE WHEN n.name = lower(trim(l.label)) THEN n.c ELSE 3 END, -n.popularity, n.id)) AS id,
  min(CASE WHEN n.name IS NULL THEN NULL WHEN n.name = lower(trim(l.label)) THEN n.c ELSE 3 END)::INTEGER AS match_class
  FROM labels l LEFT JOIN names n ON n.kind = l.kind AND starts_with(n.name, lower(trim(l.label))) GROUP BY l.kind, l.label)
"""
_LINK_VIEWS = "fx_pred fx_kb_label fx_kb_alias"


def _entity_labels(spark):
    pred = spark.table("fx_pred").withColumn("spelled", F.replace("s", F.lit("#"), F.lit(" no ")))
    return linking.distinct_labels(pred, "s", "o", "spelled")


def _predicate_labels(spark):
    more = spark.sql("SELECT stack(2, 'was a manufacturer of', 'supp') AS label")
    return linking.distinct_labels(spark.table("fx_pred"), "p").unionByName(more)


@R.add("link_entities", f"WITH {_LINK} SELECT label, id, match_class FROM best WHERE kind = 'item'", _LINK_VIEWS)
def link_entities(spark):
    """Best entry of every subject and object text, by label, alias or longer name."""
    return linking.link_labels(_entity_labels(spark), kb_label(spark), "item")


@R.add("link_predicates", f"WITH {_LINK} SELECT label, id, match_class FROM best WHERE kind = 'property'", _LINK_VIEWS)
def link_predicates(spark):
    """Best property of every predicate text."""
    return linking.link_labels(_predicate_labels(spark), kb_label(spark), "property")


_PREFIX_ROWS = ", ".join(f"({i}, '{word}')" for i, word in enumerate(PREDICATE_PREFIXES))
_FALLBACK = f"""{_LINK},
words AS (SELECT * FROM (VALUES {_PREFIX_ROWS}) t(i, word)),
hit AS (SELECT b.label, b.id AS direct_id, arg_max(w.word, w.i) AS word FROM best b LEFT JOIN words w
  ON b.id IS NULL AND starts_with(b.label, w.word) WHERE b.kind = 'property' GROUP BY b.label, b.id),
cut AS (SELECT label, direct_id, CASE WHEN word IS NOT NULL THEN string_split(label, word)[-1] END AS stripped FROM hit),
again AS (SELECT c.stripped, min_by(n.id, row(CASE WHEN n.name = lower(trim(c.stripped)) THEN n.c ELSE 3 END, -n.popularity, n.id)) AS id
  FROM (SELECT DISTINCT stripped FROM cut WHERE stripped <> '') c JOIN names n ON n.kind = 'property'
  AND starts_with(n.name, lower(trim(c.stripped))) GROUP BY c.stripped)
"""


@R.add(
    "predicate_fallback",
    f"""WITH {_FALLBACK} SELECT c.label, c.direct_id, c.stripped, coalesce(c.direct_id, a.id) AS id
FROM cut c LEFT JOIN again a ON a.stripped = c.stripped""",
    _LINK_VIEWS,
)
def predicate_fallback(spark):
    """Predicates linked directly or without their function words."""
    return linking.link_predicates(_predicate_labels(spark), kb_label(spark))


# ---------------------------------------------------------------- the whole check

_FULL_TYPES = """
e31 AS (SELECT DISTINCT s, o FROM fx_kb_statement WHERE p = 'P31'),
e279 AS (SELECT DISTINCT s, o FROM fx_kb_statement WHERE p = 'P279'),
chain AS (SELECT f.first, f.s AS id, f.o AS c0, a.o AS c1, b.o AS c2, d.o AS c3
  FROM (SELECT 'P31' AS first, * FROM e31 UNION ALL SELECT 'P279', * FROM e279) f
  JOIN e279 a ON a.s = f.o JOIN e279 b ON b.s = a.o JOIN e279 d ON d.s = b.o),
types AS (SELECT DISTINCT first, id, hop::INTEGER AS hop, class_id FROM (SELECT first, id, unnest([0, 1, 2, 3]) AS hop,
  unnest([c0, c1, c2, c3]) AS class_id FROM chain))
"""

_CHECKED = f"""{_FALLBACK}, {_FULL_TYPES},
item AS (SELECT label, id FROM best WHERE kind = 'item'),
prop AS (SELECT c.label, c.direct_id, coalesce(c.direct_id, a.id) AS id FROM cut c LEFT JOIN again a ON a.stripped = c.stripped),
flag AS (SELECT property, bool_or(ctype = 'domain') AS d, bool_or(ctype = 'range') AS r FROM fx_kb_constraint GROUP BY property),
fit AS (SELECT t.id, k.property, k.ctype, min(t.hop) AS level, min_by(t.class_id, row(t.hop, t.class_id)) AS class_id,
  min_by(k.class_label, row(t.hop, t.class_id, k.class_label)) AS class_label
  FROM types t JOIN fx_kb_constraint k ON k.class_id = t.class_id GROUP BY t.id, k.property, k.ctype),
st AS (SELECT DISTINCT s, p, o FROM fx_kb_statement),
base AS (SELECT q.run, q.doc_id, q.pos, q.s, q.p, q.o, a.id AS s_id, p.direct_id AS p_direct_id, p.id AS p_id, b.id AS o_id,
  a.id IS NOT NULL AND p.id IS NOT NULL AND b.id IS NOT NULL AS all_linked,
  coalesce(f.d, false) AS has_domain, coalesce(f.r, false) AS has_range,
  CASE WHEN p.id IS NOT NULL THEN coalesce(f.d, false) AND coalesce(f.r, false) END AS has_both,
  CASE WHEN p.id IS NOT NULL AND a.id IS NOT NULL THEN x.level IS NOT NULL END AS domain_match, x.level AS domain_level, x.class_id AS domain_class, x.class_label AS domain_label,
  CASE WHEN p.id IS NOT NULL AND b.id IS NOT NULL THEN y.level IS NOT NULL END AS range_match, y.level AS range_level, y.class_id AS range_class, y.class_label AS range_label,
  CASE WHEN a.id IS NOT NULL AND p.id IS NOT NULL AND b.id IS NOT NULL THEN st.s IS NOT NULL END AS statement
  FROM fx_pred q LEFT JOIN item a ON a.label = q.s LEFT JOIN item b ON b.label = q.o LEFT JOIN prop p ON p.label = q.p
  LEFT JOIN flag f ON f.property = p.id
  LEFT JOIN fit x ON x.id = a.id AND x.property = p.id AND x.ctype = 'domain'
  LEFT JOIN fit y ON y.id = b.id AND y.property = p.id AND y.ctype = 'range'
  LEFT JOIN st ON st.s = a.id AND st.p = p.id AND st.o = b.id),
checked AS (SELECT *, coalesce(has_both AND s_id IS NOT NULL AND o_id IS NULL, false) AS object_missing,
  coalesce(has_both AND s_id IS NULL AND o_id IS NOT NULL, false) AS subject_missing,
  coalesce(has_both AND s_id IS NULL AND o_id IS NULL, false) AS both_missing,
  CASE WHEN all_linked THEN has_both AND domain_match AND range_match END AS type_match,
  CASE WHEN all_linked AND has_both AND domain_match AND range_match THEN greatest(domain_level, range_level) END AS level,
  coalesce(all_linked AND has_both AND domain_match AND range_match AND statement, false) AS statement_and_match FROM base)
"""
_CHECK_VIEWS = "fx_pred fx_kb_label fx_kb_alias fx_kb_statement fx_kb_constraint"


def _tables(spark):
    return kb_label(spark), spark.table("fx_kb_statement"), spark.table("fx_kb_constraint")


def _checked(spark):
    return kb.check_triples(spark.table("fx_pred"), *_tables(spark))


def _checked_counts(spark):
    """Checks of distinct triples with their copies per run."""
    return kb.check_counted(spark.table("fx_pred"), *_tables(spark))


@R.add("check_triples", f"WITH {_CHECKED} SELECT * FROM checked", _CHECK_VIEWS)
def check_triples(spark):
    """Every prediction with its links, constraint flags, type matches and statement flag."""
    return _checked(spark)


_SUM = "count(*) FILTER (WHERE {0})"
_COUNTERS = {
    "triples": "count(*)", "malformed": "0::BIGINT",
    **{
        name: _SUM.format(test)
        for name, test in {
            "has_domain_range": "has_both", "domain_range_match": "type_match",
            "hop_0": "level = 0", "hop_1": "level = 1", "hop_2": "level = 2", "hop_3": "level = 3",
            "only_subject": "object_missing", "only_subject_match": "object_missing AND domain_match",
            "only_object": "subject_missing", "only_object_match": "subject_missing AND range_match",
            "neither": "both_missing", "both_linked": "all_linked AND has_both", "all_linked": "all_linked",
            "statement": "statement", "statement_and_match": "statement_and_match",
        }.items()
    },
}


@R.add(
    "kb_summary",
    f"WITH {_CHECKED} SELECT run, " + ", ".join(f"{sql} AS {name}" for name, sql in _COUNTERS.items()) + " FROM checked GROUP BY run",
    _CHECK_VIEWS,
)
def kb_summary(spark):
    """All counters of the check, per run."""
    return kb.kb_summary(_checked_counts(spark))


# Dash-separated texts in which every third triple has lost its object: that item is malformed.
_KEPT = """, numbered AS (SELECT *, row_number() OVER (PARTITION BY run, doc_id ORDER BY pos, s, p, o) AS n FROM fx_pred),
kept AS (SELECT * FROM numbered WHERE n % 3 <> 0), broken AS (SELECT run, count(*) AS malformed FROM numbered WHERE n % 3 = 0 GROUP BY run),
base AS ("""


@R.add(
    "extracted_kb_summary",
    f"WITH {_CHECKED.replace(', base AS (', _KEPT).replace(chr(10) + 'base AS (', _KEPT[1:]).replace('FROM fx_pred q LEFT', 'FROM kept q LEFT')}"
    " SELECT run, count(*) + any_value(b.malformed) AS triples, any_value(b.malformed) AS malformed, "
    + ", ".join(f"{sql} AS {name}" for name, sql in _COUNTERS.items() if name not in ("triples", "malformed"))
    + " FROM checked JOIN broken b USING (run) GROUP BY run",
    _CHECK_VIEWS,
)
def extracted_kb_summary(spark):
    """From generated texts to all counters of the check, per run, malformed items included."""
    texts = spark.sql(
        """SELECT run, doc_id, array_join(transform(ts, (t, i) -> concat(cast(i + 1 as string), '. ', t.s, ' - ', t.p,
  CASE WHEN (i + 1) % 3 = 0 THEN '' ELSE concat(' - ', t.o) END)), chr(10)) AS text FROM (SELECT run, doc_id,
  sort_array(collect_list(struct(pos, s, p, o))) AS ts FROM fx_pred GROUP BY run, doc_id)"""
    )
    return kb.summarize_texts(texts, *_tables(spark), text_col="text")


@R.add(
    "hop_histogram",
    f"WITH {_CHECKED} SELECT run, " + ", ".join(f"{_COUNTERS[f'hop_{n}']} AS hop_{n}" for n in range(4)) + " FROM checked GROUP BY run",
    _CHECK_VIEWS,
)
def hop_histogram(spark):
    """Matching triples by level, per run."""
    return kb.hop_histogram(_checked_counts(spark))


@R.add(
    "latest_by_triple",
    f"""WITH {_CHECKED} SELECT run, s, p, o, doc_id, pos, s_id, p_id, o_id, all_linked, level FROM (SELECT *, row_number() OVER (
  PARTITION BY run, s, p, o ORDER BY doc_id DESC, pos DESC) AS n FROM checked) WHERE n = 1""",
    _CHECK_VIEWS,
)
def latest_by_triple(spark):
    """The last record of every distinct triple of a run."""
    # the checks depend on the triple text only, so they join the last occurrence after the grouping
    last = kb.latest_by_triple(spark.table("fx_pred"))
    checked = kb.check_triples(last, *_tables(spark), copies=False)
    return checked.select("run", "s", "p", "o", "doc_id", "pos", "s_id", "p_id", "o_id", "all_linked", "level")


_MENTIONS = f"""{_CHECKED}, mentions AS (SELECT DISTINCT run, 'relation' AS kind, p AS label, p_direct_id AS id FROM checked
  UNION SELECT run, 'entity', s, s_id FROM checked UNION SELECT run, 'entity', o, o_id FROM checked)"""


@R.add("distinct_mentions", f"WITH {_MENTIONS} SELECT * FROM mentions", _CHECK_VIEWS)
def distinct_mentions(spark):
    """Distinct labels with their links, per run."""
    return linking.mentions(spark.table("fx_pred"), kb_label(spark))


@R.add(
    "linking_stats",
    f"""WITH {_MENTIONS} SELECT kind, run, count(*) AS all_mentions, count(id) AS linked, count(*) - count(id) AS not_linked
FROM mentions GROUP BY kind, run""",
    _CHECK_VIEWS,
)
def linking_stats(spark):
    """Linked and unlinked labels per run and kind."""
    return linking.linking_stats(linking.mentions(spark.table("fx_pred"), kb_label(spark)))


@R.add(
    "constraint_coverage",
    f"""WITH {_MENTIONS} SELECT m.run, count(*) FILTER (WHERE f.d) AS with_domain, count(*) FILTER (WHERE f.r) AS with_range,
  count(*) FILTER (WHERE f.d AND f.r) AS with_both FROM mentions m LEFT JOIN flag f ON f.property = m.id
WHERE m.kind = 'relation' AND m.id IS NOT NULL GROUP BY m.run""",
    _CHECK_VIEWS,
)
def constraint_coverage(spark):
    """Linked predicates with domain and range constraints, per run."""
    return kb.constraint_coverage(linking.mentions(spark.table("fx_pred"), kb_label(spark)), spark.table("fx_kb_constraint"))


@R.add(
    "statement_exists",
    """SELECT s_id, p_id, o_id, EXISTS (SELECT 1 FROM fx_kb_statement k WHERE k.s = s_id AND k.p = p_id AND k.o = o_id) AS statement
FROM (SELECT DISTINCT concat('S', l_suppkey) AS s_id, CASE l_linenumber % 2 WHEN 0 THEN 'L1' ELSE 'L2' END AS p_id,
  concat('P', l_partkey) AS o_id FROM lineitem)""",
    "fx_kb_statement",
)
def statement_exists(spark):
    """Which id triples the knowledge base states."""
    asked = spark.sql(
        "SELECT concat('S', l_suppkey) AS s_id, CASE l_linenumber % 2 WHEN 0 THEN 'L1' ELSE 'L2' END AS p_id, "
        "concat('P', l_partkey) AS o_id FROM lineitem"
    )
    return kb.statement_exists(asked, spark.table("fx_kb_statement"))


@R.add(
    "property_constraints",
    """SELECT p.id AS property, unnest(CASE WHEN c.d IS NULL THEN [NULL] ELSE c.d END) AS domain_class,
  unnest(CASE WHEN c.l IS NULL THEN [NULL] ELSE c.l END) AS domain_label, len(coalesce(c.d, [])) > 0 AS has_domain,
  len(coalesce(c.r, [])) > 0 AS has_range, len(coalesce(c.d, [])) > 0 AND len(coalesce(c.r, [])) > 0 AS has_both
FROM (SELECT id FROM fx_kb_label WHERE kind = 'property') p LEFT JOIN (SELECT property,
  list(class_id ORDER BY class_id) FILTER (WHERE ctype = 'domain') AS d, list(class_label ORDER BY class_id) FILTER (WHERE ctype = 'domain') AS l, list(DISTINCT class_id) FILTER (WHERE ctype = 'range') AS r
  FROM fx_kb_all_constraints GROUP BY property) c ON c.property = p.id""",
    "fx_kb_label fx_kb_all_constraints",
)
def property_constraints(spark):
    """Domain classes with their labels and constraint flags of every property."""
    known = kb.property_constraints(spark.table("fx_kb_all_constraints"))
    properties = spark.table("fx_kb_label").where("kind = 'property'").select(F.col("id").alias("property"))
    domain = F.explode_outer(F.arrays_zip("domain_classes", "domain_labels")).alias("d")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("has_domain", "has_range", "has_both")]
    return properties.join(known, "property", "left").select("property", domain, *flags).select(
        "property", F.col("d.domain_classes").alias("domain_class"), F.col("d.domain_labels").alias("domain_label"), "has_domain", "has_range", "has_both"
    )


_ALL_IDS = "SELECT DISTINCT s AS id FROM fx_kb_statement"


@R.add(
    "type_closure", f"WITH {_FULL_TYPES} SELECT id, hop, class_id FROM types WHERE first = 'P31'", "fx_kb_statement",
)
def type_closure(spark):
    """Classes of every entry along complete chains from instance-of."""
    return kb.type_closure(spark.sql(_ALL_IDS), spark.table("fx_kb_statement"))


@R.add(
    "type_closure_short",
    """WITH e31 AS (SELECT DISTINCT s, o FROM fx_kb_statement WHERE p = 'P31'), e279 AS (SELECT DISTINCT s, o FROM fx_kb_statement WHERE p = 'P279'),
 h0 AS (SELECT s AS id, o AS c FROM e31), h1 AS (SELECT DISTINCT id, o AS c FROM h0 JOIN e279 ON s = c),
 h2 AS (SELECT DISTINCT id, o AS c FROM h1 JOIN e279 ON s = c), h3 AS (SELECT DISTINCT id, o AS c FROM h2 JOIN e279 ON s = c)
SELECT id, 0::INTEGER AS hop, c AS class_id FROM h0 UNION ALL SELECT id, 1, c FROM h1 UNION ALL SELECT id, 2, c FROM h2
UNION ALL SELECT id, 3, c FROM h3""",
    "fx_kb_statement",
)
def type_closure_short(spark):
    """Classes of every entry along chains of any length up to three."""
    return kb.type_closure(spark.sql(_ALL_IDS), spark.table("fx_kb_statement"), full_chain=False)


@R.add("merged_types", f"WITH {_FULL_TYPES} SELECT DISTINCT id, hop, class_id FROM types", "fx_kb_statement")
def merged_types(spark):
    """Classes by instance-of and by subclass-of together."""
    ids, statements = spark.sql(_ALL_IDS), spark.table("fx_kb_statement")
    return kb.merge_types(kb.type_closure(ids, statements, "P31"), kb.type_closure(ids, statements, "P279"))


@R.add(
    "type_match",
    f"""WITH {_FULL_TYPES} SELECT p.id, p.property, min(t.hop) AS level, min_by(t.class_id, row(t.hop, t.class_id)) AS class_id,
  min_by(k.class_label, row(t.hop, t.class_id, k.class_label)) AS class_label
FROM (SELECT DISTINCT concat('S', l_suppkey) AS id, 'L' || (1 + l_linenumber % 3) AS property FROM lineitem) p
JOIN types t ON t.id = p.id JOIN fx_kb_constraint k ON k.property = p.property AND k.ctype = 'domain' AND k.class_id = t.class_id
GROUP BY p.id, p.property""",
    "fx_kb_statement fx_kb_constraint",
)
def type_match(spark):
    """Lowest level at which a supplier fits the domain of a property."""
    pairs = spark.sql("SELECT concat('S', l_suppkey) AS id, concat('L', 1 + l_linenumber % 3) AS property FROM lineitem")
    ids = pairs.select("id").distinct()
    types = kb.all_types(ids, spark.table("fx_kb_statement"))
    return kb.match_types(pairs, types, spark.table("fx_kb_constraint"), "domain")


@R.add(
    "type_match_range",
    f"""WITH {_FULL_TYPES} SELECT p.id, p.property, min(t.hop) AS level, min_by(t.class_id, row(t.hop, t.class_id)) AS class_id,
  min_by(k.class_label, row(t.hop, t.class_id, k.class_label)) AS class_label
FROM (SELECT DISTINCT concat('P', l_partkey) AS id, 'L' || (1 + l_linenumber % 3) AS property FROM lineitem) p
JOIN types t ON t.id = p.id JOIN fx_kb_constraint k ON k.property = p.property AND k.ctype = 'range' AND k.class_id = t.class_id
GROUP BY p.id, p.property""",
    "fx_kb_statement fx_kb_constraint",
)
def type_match_range(spark):
    """Lowest level at which a part fits the range of a property."""
    pairs = spark.sql("SELECT concat('P', l_partkey) AS id, concat('L', 1 + l_linenumber % 3) AS property FROM lineitem")
    types = kb.all_types(pairs.select("id").distinct(), spark.table("fx_kb_statement"))
    return kb.match_types(pairs, types, spark.table("fx_kb_constraint"), "range")


@R.add(
    "describe_ids",
    """SELECT i.id, coalesce(k.label, 'No label available') AS label, coalesce(k.description, 'No description available') AS description
FROM (SELECT DISTINCT o AS id FROM fx_kb_statement) i LEFT JOIN fx_kb_label k ON k.id = i.id""",
    "fx_kb_label fx_kb_statement",
)
def describe_ids(spark):
    """Label and description of every object of a statement, unknown ones included."""
    ids = spark.table("fx_kb_statement").select(F.col("o").alias("id")).distinct()
    return linking.describe_ids(ids, spark.table("fx_kb_label"), keep_unknown=True)


# ---------------------------------------------------------------- candidates

_BY_STRING = f"""{_LINK}, pairs AS (SELECT l.kind, l.label, n.id, min(CASE WHEN n.name = lower(trim(l.label)) THEN n.c ELSE 3 END) AS c,
  any_value(n.popularity) AS popularity FROM labels l JOIN names n ON n.kind = l.kind AND starts_with(n.name, lower(trim(l.label)))
  GROUP BY l.kind, l.label, n.id),
ranked AS (SELECT kind, label, id, row_number() OVER (PARTITION BY kind, label ORDER BY c, popularity DESC, id) AS rank FROM pairs)
"""
_SHOW = "r.id || ' (' || k.label || '): ' || k.description"


def _exploded(df):
    return df.select("label", F.posexplode_outer("candidates").alias("i", "candidate")).select(
        "label", (F.col("i") + 1).alias("rank"), "candidate"
    )


@R.add(
    "candidates_string",
    f"""WITH {_BY_STRING} SELECT l.label, r.rank::INTEGER AS rank, {_SHOW} AS candidate FROM labels l
LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r ON r.kind = l.kind AND r.label = l.label
LEFT JOIN fx_kb_label k ON k.id = r.id WHERE l.kind = 'item'""",
    _LINK_VIEWS,
)
def candidates_string(spark):
    """Ten best entries by name for every entity text."""
    return _exploded(candidates.candidates_by_string(_entity_labels(spark), kb_label(spark), "item"))


@R.add(
    "candidates_string_property",
    f"""WITH {_BY_STRING} SELECT l.label, r.rank::INTEGER AS rank, {_SHOW} AS candidate FROM labels l
LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r ON r.kind = l.kind AND r.label = l.label
LEFT JOIN fx_kb_label k ON k.id = r.id WHERE l.kind = 'property'""",
    _LINK_VIEWS,
)
def candidates_string_property(spark):
    """Ten best properties by name for every predicate text."""
    return _exploded(candidates.candidates_by_string(_predicate_labels(spark), kb_label(spark), "property"))


@R.add(
    "no_candidates",
    f"WITH {_BY_STRING} SELECT l.label FROM labels l WHERE l.kind = 'item' AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.kind = l.kind AND p.label = l.label)",
    _LINK_VIEWS,
)
def no_candidates(spark):
    """Entity texts without any candidate."""
    return candidates.no_candidates(candidates.candidates_by_string(_entity_labels(spark), kb_label(spark), "item"))


_WORDS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_TEXT_HITS = f"""
page AS (SELECT id, popularity, words FROM pages_in),
word AS (SELECT id, popularity, unnest(words) AS term FROM page),
tf AS (SELECT id, term, any_value(popularity) AS popularity, count(*) AS n FROM word GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
ask AS (SELECT query, unnest(terms) AS term, len(terms) AS need FROM queries_in),
hit AS (SELECT a.query, tf.id, any_value(tf.popularity) AS popularity, any_value(a.need) AS need, count(*) AS have,
  round(sum(tf.n * ln(1 + (SELECT count(*) FROM page)::DOUBLE / df.df)), 6) AS score
  FROM ask a JOIN tf ON tf.term = a.term JOIN df ON df.term = a.term GROUP BY a.query, tf.id),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, popularity DESC, id) AS rank FROM hit WHERE have = need)
"""


@R.add(
    "candidates_text",
    f"""WITH asked AS (SELECT DISTINCT unnest([s, o]) AS label FROM fx_pred),
 q AS (SELECT label, list_sort(list_distinct({_WORDS.format("label")})) AS terms FROM asked),
 queries_in AS (SELECT DISTINCT array_to_string(terms, ' ') AS query, terms FROM q WHERE len(terms) > 0),
 alias AS (SELECT id, string_agg(DISTINCT alias, ' ') AS a FROM fx_kb_alias GROUP BY id),
 pages_in AS (SELECT k.id, k.popularity, {_WORDS.format("concat_ws(' ', k.label, alias.a, k.description)")} AS words
  FROM fx_kb_label k LEFT JOIN alias ON alias.id = k.id WHERE k.kind = 'item'), {_TEXT_HITS}
SELECT q.label, r.rank::INTEGER AS rank, {_SHOW} AS candidate FROM q LEFT JOIN (SELECT * FROM top WHERE rank <= 10) r
  ON r.query = array_to_string(q.terms, ' ') LEFT JOIN fx_kb_label k ON k.id = r.id""",
    _LINK_VIEWS,
)
def candidates_text(spark):
    """Ten best entries by full-text search for every entity text."""
    labels = linking.distinct_labels(spark.table("fx_pred"), "s", "o")
    return _exploded(candidates.candidates_by_text(labels, kb_label(spark), "item"))


@R.add(
    "text_hits_documents",
    f"""WITH queries_in AS (SELECT item_id AS query, list_sort(list_distinct({_WORDS.format("text")})) AS terms FROM benchmark),
 pages_in AS (SELECT doc_id AS id, n_chars AS popularity, {_WORDS.format("text")} AS words FROM documents), {_TEXT_HITS}
SELECT query, rank::INTEGER AS rank, id, score FROM top WHERE rank <= 10""",
)
def text_hits_documents(spark):
    """Documents that hold every word of a benchmark passage, best first."""
    queries = spark.table("benchmark").select(
        F.col("item_id").alias("query"), F.sort_array(F.array_distinct(candidates.words(F.col("text")))).alias("terms")
    )
    pages = spark.table("documents").select(
        F.col("doc_id").alias("id"), F.col("n_chars").alias("popularity"), candidates.words(F.col("text")).alias("page_words")
    )
    return candidates.text_hits(queries, pages).select("query", "rank", "id", "score")


@R.add(
    "components",
    """SELECT DISTINCT run, doc_id, 'entity' AS kind, unnest([s, o]) AS label FROM fx_pred
UNION SELECT run, doc_id, 'relation', p FROM fx_pred""",
    "fx_pred",
)
def components(spark):
    """Distinct subjects, objects and predicates of every document of a run."""
    return candidates.components(spark.table("fx_pred"))
