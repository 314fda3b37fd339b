"""Queries of corpus conversion, text renderings and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tripleframe.fixed import ENTITY_TYPES, RELATIONS
from tripleframe.functions import text
from tripleframe.operators import corpus, sampling
from tripleframe.plans.catalog.registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql

_TYPES = "types AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in ENTITY_TYPES.items()) + ") t(code, type_name))"
_RELS = "rels AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i}, '{p}')" for n, i, p in RELATIONS) + ") t(name, num, pid))"
_CASE = "CASE WHEN regexp_matches({0}, '^\\p{{Lu}}') THEN {0} ELSE upper({0}[1]) || lower(substr({0}, 2)) END"
# First mentions of every surface form of a document, and the relations with their dictionary entries.
_FIRST = """first AS (SELECT doc_id, surfaceform, min(pos) AS pos, min_by(type, pos) AS type, min_by(uri, pos) AS uri
  FROM fx_mention GROUP BY doc_id, surfaceform)"""
_NAMED = f"""{_RELS}, named AS (SELECT r.*, d.name, d.pid, row_number() OVER (PARTITION BY doc_id, predicate ORDER BY pos) AS nth
  FROM fx_relation r JOIN rels d ON d.num = r.predicate)"""
_TRUE = f"""{_NAMED}, cased AS (SELECT doc_id, pos, s_form AS s, CASE WHEN nth = 1 THEN {_CASE.format("name")} ELSE name END AS p, o_form AS o FROM named),
 truth AS (SELECT doc_id, min(pos) AS pos, s, p, o FROM cased GROUP BY doc_id, s, p, o)"""
_NTH = "(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS i"


def _positions(df, column, name):
    return df.select("doc_id", F.posexplode_outer(column).alias("i", name)).where(F.col("i").isNotNull())


def _triples(df, column):
    rows = df.select("doc_id", F.posexplode_outer(column).alias("i", "t")).where(F.col("i").isNotNull())
    return rows.select("doc_id", "i", "t.s", "t.p", "t.o")


@R.add(
    "corpus_split_counts",
    """SELECT CASE l_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split,
  count(DISTINCT l_orderkey) AS documents FROM lineitem GROUP BY 1""",
)
def corpus_split_counts(spark):
    """Documents per split."""
    return corpus.split_counts(spark.table("fx_corpus"))


@R.add("convert_entities", f"WITH {_FIRST} SELECT doc_id, surfaceform AS entity, {_NTH} FROM first", "fx_mention")
def convert_entities(spark):
    """Distinct surface forms in order."""
    return _positions(spark.table("fx_corpus"), corpus.distinct_entities(F.col("entities")), "entity")


@R.add(
    "convert_entity_types",
    f"""WITH {_TYPES}, {_FIRST} SELECT doc_id, {_CASE.format("surfaceform")} || ' is a/an ' || lower(type_name) || '.' AS fact, {_NTH}
FROM first JOIN types ON code = type WHERE surfaceform <> '' AND NOT regexp_matches(surfaceform, '^\\p{{Lu}}')""",
    "fx_mention",
)
def convert_entity_types(spark):
    """Type sentences of entities that are not capitalised."""
    return _positions(spark.table("fx_corpus"), corpus.entity_type_facts(F.col("entities")), "fact")


@R.add(
    "convert_entity_ids",
    f"""WITH {_FIRST} SELECT doc_id, {_CASE.format("surfaceform")} || ' has a Wikidata ID of ' || uri || '.' AS fact, {_NTH}
FROM first WHERE surfaceform <> '' AND NOT regexp_matches(surfaceform, '^\\p{{Lu}}')""",
    "fx_mention",
)
def convert_entity_ids(spark):
    """Id sentences of entities that are not capitalised."""
    return _positions(spark.table("fx_corpus"), corpus.entity_id_facts(F.col("entities")), "fact")


@R.add("convert_relations", f"WITH {_NAMED} SELECT doc_id, name AS relation, {_NTH} FROM named WHERE nth = 1", "fx_relation")
def convert_relations(spark):
    """Distinct predicate names in order of first use."""
    return _positions(spark.table("fx_corpus"), corpus.relation_list(F.col("relations")), "relation")


@R.add(
    "convert_relation_ids",
    f"WITH {_NAMED} SELECT doc_id, {_CASE.format('name')} || ' has the Wikidata ID of ' || pid || '.' AS fact, {_NTH} FROM named WHERE nth = 1",
    "fx_relation",
)
def convert_relation_ids(spark):
    """Id sentences of the predicates used."""
    return _positions(spark.table("fx_corpus"), corpus.relation_id_facts(F.col("relations")), "fact")


@R.add("convert_triples", f"WITH {_TRUE} SELECT doc_id, s, p, o, {_NTH} FROM truth", "fx_relation")
def convert_triples(spark):
    """True triples of every document as text."""
    return _triples(spark.table("fx_corpus"), corpus.gold_string_triples(F.col("relations")))


@R.add(
    "convert_id_triples",
    f"""WITH {_NAMED} SELECT doc_id, s_uri AS s, pid AS p, o_uri AS o, {_NTH} FROM (SELECT doc_id, s_uri, pid, o_uri, min(pos) AS pos
FROM named GROUP BY ALL)""",
    "fx_relation",
)
def convert_id_triples(spark):
    """True triples of every document as ids."""
    return _triples(spark.table("fx_corpus"), corpus.gold_id_triples(F.col("relations")))


@R.add(
    "typed_triples",
    f"""WITH {_TYPES}, {_NAMED} SELECT doc_id, pos::INTEGER AS i, s_form AS subject, a.type_name AS subject_type, name AS predicate,
  o_form AS object, b.type_name AS object_type FROM named JOIN types a ON a.code = s_type JOIN types b ON b.code = o_type""",
    "fx_relation",
)
def typed_triples(spark):
    """Relations with the long type names of both ends."""
    rows = spark.table("fx_corpus").select("doc_id", F.posexplode_outer(corpus.typed_triples(F.col("relations"))).alias("i", "t"))
    return rows.where(F.col("i").isNotNull()).select("doc_id", "i", "t.*")


@R.add(
    "typed_id_triples",
    f"""WITH {_TYPES}, {_NAMED} SELECT doc_id, pos::INTEGER AS i, s_form AS subject, a.type_name AS subject_type, s_uri AS "subject_wikiID",
  name AS predicate, pid AS "predicate_wikiID", o_form AS object, b.type_name AS object_type, o_uri AS "object_wikiID"
FROM named JOIN types a ON a.code = s_type JOIN types b ON b.code = o_type""",
    "fx_relation",
)
def typed_id_triples(spark):
    """Relations with long type names and ids."""
    rows = spark.table("fx_corpus").select("doc_id", F.posexplode_outer(corpus.typed_id_triples(F.col("relations"))).alias("i", "t"))
    return rows.where(F.col("i").isNotNull()).select("doc_id", "i", "t.*")


@R.add(
    "lookup_dictionaries",
    f"""WITH {_TYPES}, {_RELS} SELECT doc_id, pos::INTEGER AS pos, type_name, name AS relation, pid AS property FROM fx_relation
LEFT JOIN types ON code = s_type LEFT JOIN rels ON num = predicate + 3""",
    "fx_relation",
)
def lookup_dictionaries(spark):
    """Type codes and predicate numbers looked up; three numbers lie outside the dictionary."""
    rows = spark.table("fx_relation").withColumn("shifted", F.col("predicate") + 3)
    named = corpus.lookup_relation(corpus.lookup_type(rows, "s_type", "type_name"), "shifted", "relation")
    return corpus.lookup_relation(named, "shifted", "property", "id").select("doc_id", "pos", "type_name", "relation", "property")


_DRAWN = f"""{_FIRST}, {_TRUE},
 ents AS (SELECT doc_id, list(surfaceform ORDER BY pos) AS e FROM first GROUP BY doc_id),
 names AS (SELECT doc_id, list(name ORDER BY pos) AS r FROM named WHERE nth = 1 GROUP BY doc_id),
 digest AS (SELECT doc_id, e, r, k, md5('13:' || doc_id || ':' || k) AS h FROM ents JOIN names USING (doc_id), (SELECT unnest([1, 2]) AS k)),
 drawn AS (SELECT doc_id, k, e[1 + ('0x' || substr(h, 1, 8))::BIGINT % len(e)] AS s, r[1 + ('0x' || substr(h, 9, 8))::BIGINT % len(r)] AS p,
   e[1 + ('0x' || substr(h, 17, 8))::BIGINT % len(e)] AS o FROM digest),
 made AS (SELECT d.* FROM drawn d WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.doc_id = d.doc_id AND lower(t.s) = lower(d.s)
   AND lower(t.p) = lower(d.p) AND lower(t.o) = lower(d.o)))"""


@R.add(
    "corrupt_triples",
    f"WITH {_DRAWN} SELECT doc_id, s, p, o, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS i FROM made",
    "fx_mention fx_relation",
)
def corrupt_triples(spark):
    """Drawn triples that the document does not state."""
    return _triples(corpus.convert_documents(spark.table("fx_corpus")), "Corrupted Triples")


@R.add(
    "explanations",
    f"""WITH {_DRAWN}, said AS (SELECT doc_id, min(k) AS k, 'The relation - ' || p || ' - does not hold between ' || s || ' and ' || o || '.' AS sentence
  FROM made GROUP BY doc_id, s, p, o)
SELECT doc_id, sentence, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS i FROM said""",
    "fx_mention fx_relation",
)
def explanations(spark):
    """A sentence per drawn triple."""
    return _positions(corpus.convert_documents(spark.table("fx_corpus")), "Explanations", "sentence")


@R.add(
    "mixed_triples",
    f"""WITH {_DRAWN}, both_kinds AS (SELECT doc_id, 0 AS part, pos, s, p, o FROM truth UNION ALL SELECT doc_id, 1, k, s, p, o FROM made)
SELECT doc_id, s, p, o, (row_number() OVER (PARTITION BY doc_id ORDER BY md5('13:' || doc_id || ':' || s || ':' || p || ':' || o), part, pos)
  - 1)::INTEGER AS i FROM both_kinds""",
    "fx_mention fx_relation",
)
def mixed_triples(spark):
    """True and drawn triples in seeded order."""
    return _triples(corpus.convert_documents(spark.table("fx_corpus")), "Mixed Triples")


# ---------------------------------------------------------------- renderings


@R.add(
    "list_text",
    f"""WITH {_FIRST}, {_TRUE}, a AS (SELECT doc_id, '[' || string_agg('''' || surfaceform || '''', ', ' ORDER BY pos) || ']' AS entities FROM first GROUP BY doc_id),
 b AS (SELECT doc_id, '[' || string_agg('[''' || s || ''', ''' || p || ''', ''' || o || ''']', ', ' ORDER BY pos) || ']' AS triples FROM truth GROUP BY doc_id)
SELECT doc_id, entities, coalesce(triples, '[]') AS triples FROM a LEFT JOIN b USING (doc_id)""",
    "fx_mention fx_relation",
)
def list_text(spark):
    """Entities and triples in Python-literal form."""
    triples = F.transform(corpus.gold_string_triples(F.col("relations")), lambda t: F.array(t["s"], t["p"], t["o"]))
    return spark.table("fx_corpus").select(
        "doc_id", text.list_literal(corpus.distinct_entities(F.col("entities"))).alias("entities"),
        text.list_literal(triples, depth=2).alias("triples"),
    )


@R.add(
    "list_text_quotes",
    r"""SELECT conv_id, turn, '[' || CASE WHEN contains(text, '''') AND NOT contains(text, '"')
  THEN '"' || replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(9), '\t') || '"'
  ELSE '''' || replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(9), '\t'), '''', '\''') || '''' END || ', ''' || role || ''']' AS shown
FROM conversations""",
)
def list_text_quotes(spark):
    """Whole conversation texts in Python-literal form."""
    shown = text.list_literal(F.array("text", "role"))
    return spark.table("conversations").select("conv_id", "turn", shown.alias("shown"))


@R.add(
    "json_text",
    r"""SELECT doc_id, '{"text": "' || array_to_string(list_transform(string_split(text, ''), lambda c: CASE
  WHEN c = '\' THEN '\\' WHEN c = '"' THEN '\"' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t'
  WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN printf('\u%04x', unicode(c))
  ELSE printf('\u%04x\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END), '')
  || '", "tags": ["' || lang || '", "' || source || '"]}' AS shown FROM documents""",
)
def json_text(spark):
    """Whole documents as JSON text with ASCII escapes."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    record = F.struct(F.col("text"), F.array("lang", "source").alias("tags"))
    return spark.table("documents").select("doc_id", text.json_text(record, kind).alias("shown"))


@R.add(
    "entity_hints",
    f"WITH {_FIRST} SELECT doc_id, {_NTH}, substr(surfaceform, 1, 2) AS hint FROM first", "fx_mention",
)
def entity_hints(spark):
    """First two characters of every distinct entity."""
    return _positions(spark.table("fx_corpus"), text.entity_hints(corpus.distinct_entities(F.col("entities"))), "hint")


@R.add(
    "run_names",
    """SELECT DISTINCT source || '_prompts_' || lang AS prompt_run, source || '_prompts_EL_' || lang AS linking_run,
  'results_from_' || source || '.json' AS checked_run FROM documents""",
)
def run_names(spark):
    """Names of prompt, linking and check runs."""
    template = F.concat(F.lit("templates/"), "source", F.lit("_prompt.json"))
    return spark.table("documents").select(
        text.prompt_run_name(template, F.concat(F.lit("data/"), "lang", F.lit(".jsonl"))).alias("prompt_run"),
        text.linking_run_name(template, F.concat(F.lit("out/KE_"), "lang", F.lit(".json"))).alias("linking_run"),
        text.checked_run_name(F.concat(F.lit("post_processed_"), "source", F.lit(".json")), "results_from").alias("checked_run"),
    ).distinct()


@R.add("id_from_uri", "SELECT page_id, string_split(url, '/')[-1] AS id FROM pages")
def id_from_uri(spark):
    """Last path segment of an address."""
    return spark.table("pages").select("page_id", text.id_from_uri(F.col("url")).alias("id"))


@R.add("select_fields", "SELECT doc_id, text FROM fx_doc_text", "fx_doc_text")
def select_fields(spark):
    """Only the fields a template needs."""
    return spark.table("fx_corpus").drop("title", "uri", "split", "entities", "relations")


# ---------------------------------------------------------------- sampling

_SAMPLE = "SELECT * FROM documents ORDER BY md5('13:' || doc_id), doc_id LIMIT 300"


@R.add("sample", f"SELECT doc_id, text FROM ({_SAMPLE})")
def sample(spark):
    """Three hundred documents without replacement."""
    return sampling.sample(spark.table("documents"), 300).select("doc_id", "text")


@R.add("sample_rest", f"SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM ({_SAMPLE}))")
def sample_rest(spark):
    """Documents whose text equals none of the sample."""
    _, rest = sampling.sample_and_rest(spark.table("documents"), 300, content=["text"])
    return rest.select("doc_id")


@R.add(
    "split",
    """SELECT doc_id, row_number() OVER (ORDER BY md5('13:' || doc_id), doc_id) <= floor(count(*) OVER () * 0.5) AS in_first FROM documents""",
)
def split(spark):
    """Documents shuffled and cut in halves of exact size."""
    return sampling.with_split(spark.table("documents").select("doc_id"))
