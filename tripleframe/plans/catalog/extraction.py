"""Queries of the text-to-triples readers.

Every reader runs alone over all generated texts (and finds its format wherever it occurs), and the
cascade runs over them as a whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleframe.functions import readers as readers
from tripleframe.functions.literals import literal_json, may_be_literal
from tripleframe.functions.shapes import string_items, variant_items
from tripleframe.functions.text import strip
from tripleframe.operators import extract
from tripleframe.plans.catalog.registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql

T = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def _shown(read):
    """Items of an ``items`` column as scalar rows."""
    rows = read.select("run", "doc_id", F.posexplode_outer("items").alias("pos", "item")).where(F.col("pos").isNotNull())
    return rows.select("run", "doc_id", "pos", F.array_join("item.parts", "|").alias("parts"))


def _rows_reader(spark, reader):
    texts = spark.table("fx_generated").withColumn("_t", strip(F.col("text")))
    return _shown(texts.withColumn("items", string_items(reader(F.col("_t")))))


def _data_reader(spark, reader):
    texts = spark.table("fx_generated").withColumn("_v", reader(strip(F.col("text"))))
    return _shown(texts.withColumn("items", variant_items(F.col("_v"))))


def _groups_sql(pattern: str, source: str = T, strip_parts: bool = False, n: int = 3) -> str:
    """Rows of the groups of all matches of ``pattern`` in ``source``."""
    quoted = pattern.replace("'", "''")
    part = r"regexp_replace(g{i}, '^\s+|\s+$', '', 'g')" if strip_parts else "g{i}"
    groups = ", ".join(f"unnest(regexp_extract_all({source}, '{quoted}', {i})) AS g{i}" for i in range(1, n + 1))
    parts = " || '|' || ".join(part.format(i=i) for i in range(1, n + 1))
    return f"""SELECT run, doc_id, pos, {parts} AS parts FROM (SELECT run, doc_id,
  unnest(range(len(regexp_extract_all({source}, '{quoted}', 1)))) ::INTEGER AS pos, {groups} FROM fx_generated)"""


def _dicts_sql(json_text: str, where: str = "true") -> str:
    """Rows of a JSON list of lists or of triple objects, or of an object that holds such a list."""
    return f"""SELECT run, doc_id, key::INTEGER AS pos, CASE WHEN json_type(value) = 'ARRAY'
  THEN array_to_string(value->>'$[*]', '|')
  ELSE concat_ws('|', value->>'$.subject', value->>'$.predicate', value->>'$.object') END AS parts
FROM (SELECT run, doc_id, unnest(json_extract(j, '$[*]')) AS value,
  unnest(range(json_array_length(j)::BIGINT)) AS key
  FROM (SELECT run, doc_id, CASE WHEN json_type(x) = 'OBJECT' THEN json_extract(x, '$.triples') ELSE x::JSON END AS j
    FROM (SELECT run, doc_id, {json_text} AS x FROM fx_generated) WHERE json_valid(x) AND {where}))"""


# The answer formats of the readers as DuckDB writes them stand in the statements below.
def _add_rows(name, reader, sql, doc):
    @R.add(name, sql, "fx_generated")
    def run(spark):
        return _rows_reader(spark, reader)

    R.queries[name].__doc__ = doc


_add_rows(
    "extract_subject_lines", readers.subject_lines,
    _groups_sql(r"Subject: (.*?), Predicate: (.*?), Object: (.*?)(?:\n|\z)"), "Subject/Predicate/Object lines",
)
_add_rows(
    "extract_subject_blocks", readers.subject_blocks,
    _groups_sql(r"(?s)Subject: (.*?)\n\nPredicate: (.*?)\n\nObject: (.*?)(?:\n\n|\z)", strip_parts=True), "Subject/Predicate/Object paragraphs",
)
_add_rows("extract_quoted_lists", readers.quoted_lists, _groups_sql(r"\['(.*?)', '(.*?)', '(.*?)'\]"), "quoted lists")
_add_rows(
    "extract_nested_lists", readers.nested_lists,
    _groups_sql(r"\['(.*?)',\s*'(.*?)',\s*'(.*?)'\]", source=rf"regexp_extract({T}, '(?s)\[\[.*?\]\]')"), "nested lists",
)
_add_rows("extract_tuples", readers.tuples, _groups_sql(r'\("([^"]+)", "([^"]+)", "([^"]+)"\)'), "tuples")
_add_rows("extract_brackets", readers.brackets, _groups_sql(r"\(\s*(.*?)\s*,\s*(.*?)\s*,\s*(.*?)\s*\)"), "brackets")


def _split_sql(pattern: str, item: str, keep: str = "true") -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT run, doc_id, (row_number() OVER (PARTITION BY run, doc_id ORDER BY n) - 1)::INTEGER AS pos, parts FROM (
  SELECT run, doc_id, n, {item} AS parts FROM (SELECT run, doc_id, unnest(regexp_extract_all({T}, '{quoted}', 1)) AS item,
    unnest(range(len(regexp_extract_all({T}, '{quoted}', 1)))) AS n FROM fx_generated) WHERE {keep})"""


_add_rows(
    "extract_numbered_lists", readers.numbered_lists,
    _split_sql(r"\d+\.\s+\[(.*?)\]", "replace(replace(item, '''', ''), ', ', '|')"), "numbered lists",
)
_add_rows(
    "extract_numbered_dashes", readers.numbered_dashes,
    rf"""SELECT run, doc_id, (row_number() OVER (PARTITION BY run, doc_id ORDER BY n, m) - 1)::INTEGER AS pos,
  replace(piece, ' - ', '|') AS parts FROM (SELECT run, doc_id, n, unnest(string_split(item, '.')) AS piece,
    unnest(range(len(string_split(item, '.')))) AS m FROM (SELECT run, doc_id,
      unnest(regexp_extract_all({T}, '\d+\.\s*([^\n]+)', 1)) AS item,
      unnest(range(len(regexp_extract_all({T}, '\d+\.\s*([^\n]+)', 1)))) AS n FROM fx_generated)) WHERE contains(piece, ' - ')""",
    "numbered lines with dashes",
)
_add_rows(
    "extract_dash_lines", readers.dash_lines,
    _split_sql(r"\d+\.\s+(.*?)\n", """replace(replace(item, '"', ''), ' - ', '|')"""), "numbered lines that end in a newline",
)


@R.add("extract_json", _dicts_sql(T), "fx_generated")
def extract_json(spark):
    """Texts that are JSON as a whole."""
    return _data_reader(spark, readers.json_value)


@R.add(
    "extract_fenced",
    _dicts_sql(rf"regexp_extract_all({T}, '```(?:json)?\n((?s:.*?))\n```', 1)[-1]", "x IS NOT NULL"), "fx_generated",
)
def extract_fenced(spark):
    """The last fenced block that is JSON."""
    return _data_reader(spark, readers.fenced_json)


@R.add(
    "extract_dict_lists",
    # the Python literals of the views hold no double quote, so swapping the quotes makes them JSON
    _dicts_sql(
        rf"(CASE WHEN contains(regexp_extract({T}, '(?s)\[\s*\{{.*?\}}\s*\]'), '\"') THEN regexp_extract({T}, '(?s)\[\s*\{{.*?\}}\s*\]')"
        rf" ELSE replace(regexp_extract({T}, '(?s)\[\s*\{{.*?\}}\s*\]'), '''', '\"') END)".replace('\\"', '"'),
        "x <> ''",
    ),
    "fx_generated",
)
def extract_dict_lists(spark):
    """The first list of objects, as JSON or as a Python literal."""
    texts = spark.table("fx_generated").withColumn("_span", readers.dict_span(strip(F.col("text"))))
    native = texts.withColumn("_v", readers.dict_span_json(F.col("_span")))
    literal = native.withColumn(
        "_py", literal_json(F.lit(None).cast("string"), F.when(F.col("_v").isNull(), F.col("_span")))
    )
    value = F.coalesce(F.col("_v"), F.try_parse_json(F.col("_py.span")))
    return _shown(literal.withColumn("_v", value).withColumn("items", variant_items(F.col("_v"))))


@R.add(
    "extract_literals",
    # a quoted text without inner single quotes: what stands between the quotes
    _dicts_sql(rf"regexp_extract({T}, '(?s)^''([^'']*)''$', 1)", "x <> ''"), "fx_generated",
)
def extract_literals(spark):
    """Python string literals that hold JSON."""
    texts = spark.table("fx_generated").withColumn("_t", strip(F.col("text")))
    gated = F.when(readers.json_value(F.col("_t")).isNull() & may_be_literal(F.col("_t")), F.col("_t"))
    literal = texts.withColumn("_py", literal_json(gated, F.lit(None).cast("string")))
    return _shown(
        literal.withColumn("_v", F.try_parse_json(F.col("_py.whole"))).withColumn("items", variant_items(F.col("_v")))
    )


@R.add(
    "extract_numbered_dicts",
    _dicts_sql(
        rf"('[' || array_to_string(regexp_extract_all({T}, '\d+\.\s+(\{{.*?\}})', 1), ', ') || ']')", "x <> '[]'"
    ),
    "fx_generated",
)
def extract_numbered_dicts(spark):
    """Numbered JSON objects."""
    return _data_reader(spark, readers.numbered_dicts)


# What the cascade must give is known without reading the texts: they were written from fx_pred, one format
# per document, and all but the prose format are readable.
_READER = """CASE doc_id % 16 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'json' WHEN 3 THEN 'quoted_lists'
 WHEN 4 THEN 'subject_lines' WHEN 5 THEN 'subject_blocks' WHEN 6 THEN 'fenced_json' WHEN 7 THEN 'tuples'
 WHEN 8 THEN 'numbered_lists' WHEN 9 THEN 'numbered_dicts' WHEN 10 THEN 'numbered_dashes' WHEN 12 THEN 'nested_lists'
 WHEN 13 THEN 'dict_list' WHEN 14 THEN 'brackets' WHEN 15 THEN 'literal' ELSE 'none' END"""
_NUMBERED = """SELECT run, doc_id, s, p, o, row_number() OVER (PARTITION BY run, doc_id ORDER BY pos, s, p, o) AS n,
 count(*) OVER (PARTITION BY run, doc_id) AS total FROM fx_pred"""


@R.add(
    "extract_cascade",
    f"""SELECT run, doc_id, (n - 1)::INTEGER AS pos, {_READER} AS reader, s, p, o, true AS well_formed
FROM ({_NUMBERED}) WHERE doc_id % 16 <> 11""",
    "fx_pred",
)
def extract_cascade(spark):
    """All readers in order over every generated text."""
    found = extract.extract_triples(spark.table("fx_generated"), "text")
    return found.select("run", "doc_id", "pos", "reader", "s", "p", "o", "well_formed")


@R.add(
    "extract_cascade_strict",
    f"""SELECT run, doc_id, (row_number() OVER (PARTITION BY run, doc_id ORDER BY n) - 1)::INTEGER AS pos, {_READER} AS reader, s, p, o
FROM ({_NUMBERED}) WHERE doc_id % 16 <> 11 AND CASE doc_id % 16 WHEN 4 THEN n < total WHEN 5 THEN n = total - 1
  WHEN 10 THEN n = total ELSE true END""",
    "fx_pred",
)
def extract_cascade_strict(spark):
    """The readers in their historical order and extent."""
    found = extract.extract_triples(spark.table("fx_generated"), "text", strict_order=True)
    return found.select("run", "doc_id", "pos", "reader", "s", "p", "o")


@R.add(
    "extract_status",
    f"""SELECT run, doc_id, {_READER} AS reader, CASE doc_id % 16 WHEN 11 THEN 'empty' WHEN 5 THEN 'unreadable' ELSE 'triples' END AS status
FROM (SELECT DISTINCT run, doc_id FROM fx_pred)""",
    "fx_pred",
)
def extract_status(spark):
    """Reader and status of every text, with the shapes the knowledge-base check accepts."""
    return extract.read_texts(spark.table("fx_generated"), "text", capitals=False).select("run", "doc_id", "reader", "status")


@R.add(
    "unreadable",
    "SELECT run, doc_id, text FROM fx_generated WHERE doc_id % 16 = 5", "fx_generated",
)
def unreadable(spark):
    """Texts whose answer has a shape the knowledge-base check does not know."""
    read = extract.read_texts(spark.table("fx_generated"), "text", capitals=False)
    return extract.unreadable(read).select("run", "doc_id", "text")


@R.add(
    "canonical_triples",
    """SELECT run, doc_id, (n - 1)::INTEGER AS pos, lower(s) AS s, lower(p) AS p, lower(o) AS o, true AS matchable
FROM (SELECT run, doc_id, s, p, o, row_number() OVER (PARTITION BY run, doc_id ORDER BY pos, s, p, o) AS n FROM fx_pred)
WHERE doc_id % 16 <> 11""",
    "fx_pred",
)
def canonical_triples(spark):
    """Extracted triples in lower case."""
    found = extract.canonical_triples(extract.extract_triples(spark.table("fx_generated"), "text"))
    return found.select("run", "doc_id", "pos", "s", "p", "o", "matchable")


# Lists whose items are sets and tuples by turns, as no JSON can hold them; a set is read in the order of its values.
_AS_SET = "(n % 3 <> 2 OR n = total)"
_SETS = f"""SELECT run, doc_id, n, {_AS_SET} AS as_set, CASE WHEN {_AS_SET}
  THEN array_to_string(list_sort(list_distinct([s, p, o])), '|') ELSE s || '|' || p || '|' || o END AS parts FROM ({_NUMBERED})"""


def _with_sets(spark):
    return spark.sql(
        """SELECT run, doc_id, concat('Found [', array_join(transform(ts, (t, i) -> CASE WHEN (i + 1) % 3 <> 2 OR i + 1 = size(ts)
  THEN concat("{'", t.s, "', '", t.p, "', '", t.o, "'}") ELSE concat("('", t.s, "', '", t.p, "', '", t.o, "')") END), ', '),
  '] in the text') AS text FROM (SELECT run, doc_id, sort_array(collect_list(struct(pos, s, p, o))) AS ts FROM fx_pred GROUP BY run, doc_id)"""
    )


@R.add("extract_sets", f"SELECT run, doc_id, (n - 1)::INTEGER AS pos, 'dict_list' AS reader, parts FROM ({_SETS})", "fx_pred")
def extract_sets(spark):
    """Lists of sets and tuples of every run and document."""
    found = extract.extract_triples(_with_sets(spark), "text")
    return found.select("run", "doc_id", "pos", "reader", F.array_join("parts", "|").alias("parts"))


@R.add(
    "extract_sets_strict",
    f"""SELECT run, doc_id, (row_number() OVER (PARTITION BY run, doc_id ORDER BY n) - 1)::INTEGER AS pos, 'dict_list' AS reader, parts
FROM ({_SETS}) WHERE as_set""",
    "fx_pred",
)
def extract_sets_strict(spark):
    """The same with the historical extent: a list that holds a set keeps nothing but its sets."""
    found = extract.extract_triples(_with_sets(spark), "text", strict_order=True)
    return found.select("run", "doc_id", "pos", "reader", F.array_join("parts", "|").alias("parts"))


# Dash-separated text with one part dropped now and then: what comes out with two parts is malformed.
_UNEVEN = """SELECT run, doc_id, string_agg(n || '. ' || s || ' - ' || p || CASE WHEN n % 3 = 0 THEN '' ELSE ' - ' || o END, chr(10)
  ORDER BY n) AS text FROM (SELECT *, row_number() OVER (PARTITION BY run, doc_id ORDER BY pos, s, p, o) AS n FROM fx_pred) GROUP BY run, doc_id"""


def _uneven(spark):
    return spark.sql(
        """SELECT run, doc_id, array_join(transform(ts, (t, i) -> concat(cast(i + 1 as string), '. ', t.s, ' - ', t.p,
  CASE WHEN (i + 1) % 3 = 0 THEN '' ELSE concat(' - ', t.o) END)), chr(10)) AS text FROM (SELECT run, doc_id,
  sort_array(collect_list(struct(pos, s, p, o))) AS ts FROM fx_pred GROUP BY run, doc_id)"""
    )


@R.add(
    "malformed",
    """SELECT run, doc_id, (n - 1)::INTEGER AS pos, s || '|' || p AS parts FROM (SELECT *, row_number() OVER (
  PARTITION BY run, doc_id ORDER BY pos, s, p, o) AS n FROM fx_pred) WHERE n % 3 = 0""",
    "fx_pred",
)
def malformed(spark):
    """Extracted items that have not three parts."""
    _, broken = extract.split_valid(extract.extract_triples(_uneven(spark), "text"))
    return broken.select("run", "doc_id", "pos", F.array_join("parts", "|").alias("parts"))


@R.add(
    "malformed_counts",
    """SELECT run, count(*) AS triples, count(*) FILTER (WHERE n % 3 = 0) AS malformed FROM (SELECT *, row_number() OVER (
  PARTITION BY run, doc_id ORDER BY pos, s, p, o) AS n FROM fx_pred) GROUP BY run""",
    "fx_pred",
)
def malformed_counts(spark):
    """Items and malformed items per run."""
    return extract.malformed_counts(extract.extract_triples(_uneven(spark), "text"))


@R.add(
    "fenced_components",
    """WITH t AS (SELECT run, doc_id, s, p, o, row_number() OVER (PARTITION BY run, doc_id ORDER BY pos, s, p, o) - 1 AS n FROM fx_pred)
SELECT run, doc_id, 'triples' AS status, n::INTEGER AS pos, s, p, o FROM t WHERE doc_id % 16 = 1
UNION ALL SELECT DISTINCT run, doc_id, 'malformed', NULL::INTEGER, NULL, NULL, NULL FROM t WHERE doc_id % 16 <> 1""",
    "fx_pred",
)
def fenced_components(spark):
    """Answers that are one list of triple objects; all others are reported as malformed."""
    return extract.extract_fenced_json(spark.table("fx_generated"), "text")


def _cascade_sql() -> str:
    """The pattern readers in their order, each as the number of its items; JSON values and Python literals aren't prose."""

    def hits(pattern: str, source: str = "text") -> str:
        quoted = pattern.replace("'", "''")
        return f"len(regexp_extract_all({source}, '{quoted}', 1))"

    # The answer formats, as in the statements above.
    counts = {
        "subject_lines": hits(r"Subject: (.*?), Predicate: (.*?), Object: (.*?)(?:\n|\z)"),
        "subject_blocks": hits(r"(?s)Subject: (.*?)\n\nPredicate: (.*?)\n\nObject: (.*?)(?:\n\n|\z)"),
        "quoted_lists": hits(r"\['(.*?)', '(.*?)', '(.*?)'\]"),
        "nested_lists": hits(r"\['(.*?)',\s*'(.*?)',\s*'(.*?)'\]", r"regexp_extract(text, '(?s)\[\[.*?\]\]')"),
        "tuples": hits(r'\("([^"]+)", "([^"]+)", "([^"]+)"\)'),
        "numbered_lists": hits(r"\d+\.\s+\[(.*?)\]"),
        "numbered_dashes": r"""len(list_filter(flatten(list_transform(regexp_extract_all(text, '\d+\.\s*([^\n]+)', 1),
  lambda x: string_split(x, '.'))), lambda x: contains(x, ' - ')))""",
        "brackets": hits(r"\(\s*(.*?)\s*,\s*(.*?)\s*,\s*(.*?)\s*\)"),
        "dash_lines": hits(r"\d+\.\s+(.*?)\n"),
    }
    numbers = ", ".join(f"{sql} AS {name}" for name, sql in counts.items())
    reader = " ".join(f"WHEN {name} > 0 THEN '{name}'" for name in counts)
    items = " ".join(f"WHEN {name} > 0 THEN {name}" for name in counts)
    return f"""WITH found AS (SELECT source AS run, {numbers} FROM (SELECT source, coalesce({T}, '') AS text FROM documents))
SELECT run, reader, CASE WHEN items = 0 THEN 'empty' ELSE 'triples' END AS status, count(*) AS documents, sum(items)::BIGINT AS items
FROM (SELECT run, CASE {reader} ELSE 'none' END AS reader, CASE {items} ELSE 0 END AS items FROM found) GROUP BY ALL"""


@R.add("read_documents", _cascade_sql())
def read_documents(spark):
    """The cascade over the whole test documents: what plain prose gives."""
    texts = spark.table("documents").select(F.col("source").alias("run"), "doc_id", "text")
    return extract.read_texts(texts, "text").groupBy("run", "reader", "status").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.size("items")).cast("bigint").alias("items")
    )
