"""Queries of retrieval, prompts, generation and embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleframe.functions import text
from tripleframe.functions.shipping import ship_by_value
from tripleframe.operators import generate as gen
from tripleframe.operators import prompts, retrieve, sampling
from tripleframe.plans import templates
from tripleframe.plans.catalog.knowledge import _LINK, _SHOW, _WORDS, _TEXT_HITS, kb_label
from tripleframe.plans.catalog.registry import Registry
from tripleframe.shared import stored

ship_by_value(__name__)

R = Registry()
QUERIES, SQL = R.queries, R.sql

# ---------------------------------------------------------------- retrieval

# All vectors take part: a seeded split makes one half the pool and the other half the queries.
_NEAR = """halves AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY md5('13:' || vec_id), vec_id)
  <= floor(count(*) OVER () * 0.5) AS in_pool FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, p.vec_id AS id, p.e, round(list_cosine_similarity(q.e, p.e), 9) AS similarity
  FROM halves q JOIN halves p ON NOT q.in_pool AND p.in_pool),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM pairs QUALIFY rank <= 20)"""
_MMR = f"""{_NEAR},
one AS (SELECT query_id, id, e FROM near WHERE rank = 1),
two AS (SELECT n.query_id, n.id, n.e, row_number() OVER (PARTITION BY n.query_id
  ORDER BY round(0.5 * n.similarity - 0.5 * list_cosine_similarity(n.e, one.e), 9) DESC, n.rank) AS r
  FROM near n JOIN one USING (query_id) WHERE n.id <> one.id QUALIFY r = 1),
three AS (SELECT n.query_id, n.id, row_number() OVER (PARTITION BY n.query_id ORDER BY round(0.5 * n.similarity
  - 0.5 * greatest(list_cosine_similarity(n.e, one.e), list_cosine_similarity(n.e, two.e)), 9) DESC, n.rank) AS r3
  FROM near n JOIN one USING (query_id) JOIN two USING (query_id) WHERE n.id <> one.id AND n.id <> two.id QUALIFY r3 = 1),
mmr AS (SELECT query_id, 1 AS rank, id FROM one UNION ALL SELECT query_id, 2, id FROM two UNION ALL SELECT query_id, 3, id FROM three)"""


def _halves(spark):
    vectors = sampling.with_split(spark.table("embeddings").select("vec_id", "embedding"), key="vec_id")
    pool = vectors.where("in_first").select(F.col("vec_id").alias("id"), "embedding")
    queries = vectors.where("not in_first").select(F.col("vec_id").alias("query_id"), "embedding")
    return queries, pool


@R.add("similar_k", f"WITH {_NEAR} SELECT query_id, rank::INTEGER AS rank, id, round(similarity, 6) AS similarity FROM near WHERE rank <= 5")
def similar_k(spark):
    """Five most similar vectors of the pool half for every vector of the other half."""
    return retrieve.similar_examples(*_halves(spark), 5).withColumn("similarity", F.round("similarity", 6))


@R.add("mmr_1", f"WITH {_NEAR} SELECT query_id, 1::INTEGER AS rank, id FROM near WHERE rank = 1")
def mmr_1(spark):
    """One example per query by maximal marginal relevance: the most similar."""
    return retrieve.mmr_examples(*_halves(spark), 1)


@R.add("mmr_3", f"WITH {_MMR} SELECT query_id, rank::INTEGER AS rank, id FROM mmr")
def mmr_3(spark):
    """Three examples per query by maximal marginal relevance."""
    return retrieve.mmr_examples(*_halves(spark), 3)


# The same over letter counts of documents: a pool of 300, all others ask.
_COUNTS = "list_transform(range(16), lambda b: len(list_filter(string_split(lang || ' ' || text, ''), lambda c: unicode(c) % 16 = b))::DOUBLE)"
_DOC_MMR = _MMR.replace(
    _NEAR.split("pairs AS")[0],
    f"""halves AS (SELECT doc_id AS vec_id, {_COUNTS} AS e, row_number() OVER (ORDER BY md5('13:' || doc_id), doc_id) <= 300 AS in_pool FROM documents),
""",
)

# ---------------------------------------------------------------- prompts


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_template(template: str, slots: dict[str, str]) -> str:
    """The template as SQL concatenation; braces are written single here."""
    sql = _sql_text(template)
    for slot, value in slots.items():
        sql = sql.replace("{" + slot + "}", f"' || {value} || '")
    return sql.replace("{{", "{").replace("}}", "}")


@R.add(
    "prompts_zero_shot",
    " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS template, {_sql_template(t, {'Text': 'text'})} AS prompt FROM documents"
        for name, t in templates.ZERO_SHOT.items()
    ),
)
def prompts_zero_shot(spark):
    """Whole documents in every fixed template."""
    docs = spark.table("documents").select("doc_id", F.col("text").alias("Text"))
    return prompts.fill_template(docs, templates.ZERO_SHOT)


@R.add(
    "prompts_few_shot",
    f"""WITH {_DOC_MMR}, shown AS (SELECT m.query_id, string_agg({_sql_template(templates.FEW_SHOT["formatter"], {"Text": "d.text", "Lang": "d.lang"})},
  chr(10) ORDER BY m.rank) AS demos FROM mmr m JOIN documents d ON d.doc_id = m.id GROUP BY m.query_id)
SELECT q.doc_id AS query_id, {_sql_text(templates.FEW_SHOT["prefix"])} || chr(10) || s.demos || chr(10) ||
  {_sql_template(templates.FEW_SHOT["suffix"], {"Text": "q.text"})} AS prompt FROM documents q JOIN shown s ON s.query_id = q.doc_id""",
)
def prompts_few_shot(spark):
    """Every document outside a sampled pool of 300, with three demonstrations retrieved from the pool."""
    pool, rest = sampling.sample_and_rest(spark.table("documents").select("doc_id", "text", "lang"), 300, content=["doc_id"])
    encoded = [retrieve.embed(df, _letter_counts, ["text", "lang"]) for df in (rest, pool)]
    vectors = [df.select(F.col("doc_id").alias(key), "embedding") for df, key in zip(encoded, ("query_id", "id"))]
    shown = pool.select(F.col("doc_id").alias("id"), F.col("text").alias("Text"), F.col("lang").alias("Lang"))
    demos = retrieve.mmr_examples(*vectors, 3)
    asked = rest.select(F.col("doc_id").alias("query_id"), F.col("text").alias("Text"))
    return prompts.few_shot_prompts(asked, demos, templates.FEW_SHOT, shown=shown).select("query_id", "prompt")


@R.add("escape_braces", "SELECT page_id, replace(replace(html, '{', '{{'), '}', '}}') AS escaped FROM pages")
def escape_braces(spark):
    """Whole pages with doubled braces."""
    return spark.table("pages").select("page_id", text.escape_braces(F.col("html")).alias("escaped"))


# The relation dictionary of the views: predicate numbers spread over the three properties they know.
_NAMES, _IDS = ("supplies", "manufacturer of", "located in"), ("L1", "L2", "L3")
DICTIONARY = [(_NAMES[n % 3], n, _IDS[n % 3]) for n in range(32)]

_PARTS = f"""named AS (SELECT *, 'L' || (1 + predicate % 3) AS pid FROM fx_relation),
mentioned AS (SELECT DISTINCT doc_id, 'entity' AS kind, unnest([s_uri, o_uri]) AS id FROM named UNION SELECT doc_id, 'relation', pid FROM named),
parts AS (SELECT m.doc_id, m.kind, m.id, k.label, k.description FROM mentioned m JOIN fx_kb_label k ON k.id = m.id)"""
_PART_VIEWS = "fx_relation fx_doc_text fx_kb_label fx_kb_alias"


def _linking_docs(spark):
    return prompts.linking_documents(spark.table("fx_corpus"), kb_label(spark), dictionary=DICTIONARY)


@R.add(
    "linking_documents",
    f"""WITH {_PARTS} SELECT d.doc_id, d.text, coalesce(n, 0) AS relations, coalesce(e, '') AS entities, coalesce(p, '') AS properties FROM fx_doc_text d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM fx_relation GROUP BY doc_id) r USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(id || '|' || label || '|' || description, ';' ORDER BY id) FILTER (WHERE kind = 'entity') AS e,
  string_agg(id || '|' || label || '|' || description, ';' ORDER BY id) FILTER (WHERE kind = 'relation') AS p FROM parts GROUP BY doc_id) USING (doc_id)""",
    _PART_VIEWS,
)
def linking_documents(spark):
    """Documents with typed triples and described ids."""
    def shown(column):
        entries = F.sort_array(F.map_values(column))
        return F.array_join(F.transform(entries, lambda v: F.concat_ws("|", v["id"], v["label"], v["description"])), ";")

    return _linking_docs(spark).select(
        "doc_id", "text", F.size("wiki_triples").cast("bigint").alias("relations"),
        shown("entities").alias("entities"), shown("properties").alias("properties"),
    )


# Ten best candidates of every (kind, label): by name, and by full text for entities.
_CANDIDATES = f"""{_PARTS}, {_LINK.replace("labels AS (", "unused AS (", 1)
  .replace("best AS (", "labels AS (SELECT DISTINCT CASE kind WHEN 'entity' THEN 'item' ELSE 'property' END AS kind, label FROM parts), best AS (", 1)},
pairs AS (SELECT l.kind, l.label, n.id, min(CASE WHEN n.name = lower(trim(l.label)) THEN n.c ELSE 3 END) AS c, any_value(n.popularity) AS popularity
  FROM labels l JOIN names n ON n.kind = l.kind AND starts_with(n.name, lower(trim(l.label))) GROUP BY l.kind, l.label, n.id),
ranked AS (SELECT kind, label, id, row_number() OVER (PARTITION BY kind, label ORDER BY c, popularity DESC, id) AS rank FROM pairs QUALIFY rank <= 10),
by_name AS (SELECT r.kind, r.label, list({_SHOW} ORDER BY r.rank) AS candidates FROM ranked r JOIN fx_kb_label k ON k.id = r.id GROUP BY r.kind, r.label)"""
_BY_TEXT = f"""{_CANDIDATES}, asked AS (SELECT DISTINCT label FROM parts WHERE kind = 'entity'),
 q AS (SELECT label, list_sort(list_distinct({_WORDS.format("label")})) AS terms FROM asked),
 queries_in AS (SELECT DISTINCT array_to_string(terms, ' ') AS query, terms FROM q WHERE len(terms) > 0),
 alias AS (SELECT id, string_agg(DISTINCT alias, ' ') AS a FROM fx_kb_alias GROUP BY id),
 pages_in AS (SELECT k.id, k.popularity, {_WORDS.format("concat_ws(' ', k.label, alias.a, k.description)")} AS words
  FROM fx_kb_label k LEFT JOIN alias ON alias.id = k.id WHERE k.kind = 'item'), {_TEXT_HITS},
 by_text AS (SELECT q.label, list({_SHOW} ORDER BY r.rank) AS candidates FROM q JOIN (SELECT * FROM top WHERE rank <= 10) r
  ON r.query = array_to_string(q.terms, ' ') JOIN fx_kb_label k ON k.id = r.id GROUP BY q.label)"""
_CAND_VIEWS = "fx_pred " + _PART_VIEWS


def _corpus(spark):
    """The documents, written once: every later step reads them several times."""
    return stored(spark.table("fx_corpus").select("doc_id", "text", "relations"), "corpus")


def _parts(spark, docs):
    return prompts.corpus_components(docs, kb_label(spark), dictionary=DICTIONARY)


def _demos_shown(df):
    return df.withColumn("candidates", F.array_join("candidates", ";"))


@R.add(
    "el_demonstrations",
    f"""WITH {_CANDIDATES} SELECT p.doc_id, p.kind, '"' || d.text || '"' AS text, p.label AS extracted_component, p.id AS correct_answer,
  array_to_string(c.candidates, ';') AS candidates FROM parts p JOIN fx_doc_text d ON d.doc_id = p.doc_id
LEFT JOIN by_name c ON c.label = p.label AND c.kind = CASE p.kind WHEN 'entity' THEN 'item' ELSE 'property' END""",
    _CAND_VIEWS,
)
def el_demonstrations(spark):
    """A demonstration per entity and property of every document, candidates by name."""
    docs = _corpus(spark)
    return _demos_shown(prompts.el_demonstrations(docs, kb_label(spark), "string_search", parts=_parts(spark, docs)))


@R.add(
    "el_demonstrations_text",
    f"""WITH {_BY_TEXT} SELECT p.doc_id, p.kind, '"' || d.text || '"' AS text, p.label AS extracted_component, p.id AS correct_answer,
  array_to_string(CASE p.kind WHEN 'entity' THEN t.candidates ELSE c.candidates END, ';') AS candidates FROM parts p JOIN fx_doc_text d ON d.doc_id = p.doc_id
LEFT JOIN by_name c ON c.label = p.label AND c.kind = 'property' LEFT JOIN by_text t ON t.label = p.label""",
    _CAND_VIEWS,
)
def el_demonstrations_text(spark):
    """A demonstration per entity and property, entity candidates by full text."""
    docs = stored(_linking_docs(spark).select("doc_id", "text", "entities", "properties"), "linking-documents")
    return _demos_shown(prompts.el_demonstrations(docs, kb_label(spark), "page_search"))


_LITERAL = "'[''' || array_to_string(c.candidates, ''', ''') || ''']'"


@R.add(
    "el_prompts",
    f"""WITH {_CANDIDATES} SELECT p.doc_id, p.kind, p.label, p.id AS correct_answer, c.candidates IS NULL AS no_candidates,
  {_sql_template(templates.LINKING, {"extracted_component": "p.label", "text": chr(39) + chr(34) + chr(39) + " || d.text || " + chr(39) + chr(34) + chr(39),
                                     "candidates": f"coalesce({_LITERAL}, 'None')"})} AS prompt
FROM parts p JOIN fx_doc_text d ON d.doc_id = p.doc_id
LEFT JOIN by_name c ON c.label = p.label AND c.kind = CASE p.kind WHEN 'entity' THEN 'item' ELSE 'property' END""",
    _CAND_VIEWS,
)
def el_prompts(spark):
    """Linking prompts for the gold components."""
    docs = _corpus(spark)
    return prompts.el_prompts(docs, kb_label(spark), templates.LINKING, parts=_parts(spark, docs))


_FROM_EXTRACTIONS = f"""WITH {_LINK.replace("labels AS (", "unused AS (", 1)
  .replace("best AS (", "comps AS (SELECT DISTINCT run, doc_id, 'item' AS k, unnest([s, o]) AS label FROM fx_pred UNION SELECT run, doc_id, 'property', p FROM fx_pred), labels AS (SELECT DISTINCT k AS kind, label FROM comps), best AS (", 1)},
pairs AS (SELECT l.kind, l.label, n.id, min(CASE WHEN n.name = lower(trim(l.label)) THEN n.c ELSE 3 END) AS c, any_value(n.popularity) AS popularity
  FROM labels l JOIN names n ON n.kind = l.kind AND starts_with(n.name, lower(trim(l.label))) GROUP BY l.kind, l.label, n.id),
ranked AS (SELECT kind, label, id, row_number() OVER (PARTITION BY kind, label ORDER BY c, popularity DESC, id) AS rank FROM pairs QUALIFY rank <= 10),
by_name AS (SELECT r.kind, r.label, list({_SHOW} ORDER BY r.rank) AS candidates FROM ranked r JOIN fx_kb_label k ON k.id = r.id GROUP BY r.kind, r.label)
SELECT p.run, p.doc_id, CASE p.k WHEN 'item' THEN 'entity' ELSE 'relation' END AS kind, p.label, c.candidates IS NULL AS no_candidates,
  {_sql_template(templates.LINKING, {"extracted_component": "p.label", "text": chr(39) + chr(34) + chr(39) + " || d.text || " + chr(39) + chr(34) + chr(39),
                                     "candidates": f"coalesce({_LITERAL}, 'None')"})} AS prompt
FROM comps p JOIN fx_doc_text d ON d.doc_id = p.doc_id LEFT JOIN by_name c ON c.kind = p.k AND c.label = p.label"""


@R.add("el_prompts_from_extractions", _FROM_EXTRACTIONS, "fx_mention fx_pred fx_doc_text fx_kb_label fx_kb_alias")
def el_prompts_from_extractions(spark):
    """Linking prompts for the components of every prediction."""
    return prompts.el_prompts_from_extractions(
        spark.table("fx_pred"), spark.table("fx_corpus"), kb_label(spark), templates.LINKING
    )


# of the answer formats, number 1 is a list of triple objects
@R.add(
    "el_prompts_from_generations",
    _FROM_EXTRACTIONS.replace("unnest([s, o]) AS label FROM fx_pred UNION", "unnest([s, o]) AS label FROM fx_pred WHERE doc_id % 16 = 1 UNION")
    .replace("SELECT run, doc_id, 'property', p FROM fx_pred", "SELECT run, doc_id, 'property', p FROM fx_pred WHERE doc_id % 16 = 1"),
    "fx_mention fx_pred fx_doc_text fx_kb_label fx_kb_alias",
)
def el_prompts_from_generations(spark):
    """Linking prompts for the components of every generated answer that is a list of triple objects."""
    return prompts.el_prompts_from_generations(
        spark.table("fx_generated"), spark.table("fx_corpus"), kb_label(spark), templates.LINKING, "text"
    )


# ---------------------------------------------------------------- caller-supplied functions


def _letter_counts():
    """A stand-in encoder: how often each of 16 letter classes occurs."""
    def encode(texts):
        vectors = []
        for value in texts:
            counts = [0.0] * 16
            for char in value:
                counts[ord(char) % 16] += 1.0
            vectors.append(counts)
        return vectors

    return encode


def _echo():
    """A stand-in generator: the length of the prompt and the prompt."""
    return lambda texts: [f"{len(t)}:{t}" for t in texts]


@R.add("generate_stub", "SELECT conv_id, turn, length(text) || ':' || text AS generated_text, NULL::VARCHAR AS error FROM conversations")
def generate_stub(spark):
    """A caller's generator over whole conversation texts."""
    asked = spark.table("conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    return gen.generate(asked, _echo).select("conv_id", "turn", "generated_text", "error")


@R.add(
    "embed_stub",
    "SELECT doc_id, b::INTEGER AS dim, len(list_filter(string_split(lang || ' ' || text, ''), lambda c: unicode(c) % 16 = b))::FLOAT AS value"
    " FROM documents, range(16) r(b)",
)
def embed_stub(spark):
    """A caller's encoder over whole documents."""
    vectors = retrieve.embed(spark.table("documents").select("doc_id", "text", "lang"), _letter_counts, ["text", "lang"])
    return vectors.select("doc_id", F.posexplode("embedding").alias("dim", "value"))


_LETTERS = "list_transform(range(16), lambda b: len(list_filter(string_split({0}, ''), lambda c: unicode(c) % 16 = b))::DOUBLE)"
_JSON_LIST = "CASE WHEN {0}.candidates IS NULL THEN 'null' ELSE '[\"' || array_to_string({0}.candidates, '\", \"') || '\"]' END"
_SHOT = {"text": "{0}.text", "extracted_component": "{0}.shown", "candidates": _JSON_LIST, "correct_answer": "{0}.id"}


def _shot(template, row, **other):
    return _sql_template(template, {slot: value.format(row) for slot, value in (_SHOT | other).items()})


@R.add(
    "el_prompts_few_shot",
    f"""WITH {_CANDIDATES}, pool AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM fx_mention) ORDER BY md5('13:' || doc_id), doc_id LIMIT 300),
demo AS (SELECT p.doc_id, p.kind, p.id, p.label, '"' || d.text || '"' AS text, '"' || p.label || '"' AS shown, c.candidates, p.doc_id IN (SELECT doc_id FROM pool) AS in_pool
  FROM parts p JOIN fx_doc_text d ON d.doc_id = p.doc_id LEFT JOIN by_name c ON c.label = p.label AND c.kind = CASE p.kind WHEN 'entity' THEN 'item' ELSE 'property' END),
in_text AS (SELECT doc_id, {_LETTERS.format("text")} AS e FROM (SELECT DISTINCT doc_id, text FROM demo)),
in_part AS (SELECT kind, id, {_LETTERS.format("concat_ws(' ', array_to_string(candidates, ' '), label) || ' '")} AS e FROM (SELECT DISTINCT kind, id, label, candidates FROM demo)),
coded AS (SELECT d.*, d.doc_id || '/' || d.kind || '/' || d.id AS key, list_transform(range(1, 17), lambda i: t.e[i] + p.e[i]) AS v,
    list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::DOUBLE[16] AS e
  FROM demo d JOIN in_text t ON t.doc_id = d.doc_id JOIN in_part p ON p.kind = d.kind AND p.id = d.id),
offered AS (SELECT *, row_number() OVER (ORDER BY key) AS n FROM coded WHERE in_pool),
asking AS (SELECT *, row_number() OVER (ORDER BY key) AS m FROM coded WHERE NOT in_pool),
-- the place among equally near ones is in the last digits
closest AS (SELECT q.m, max(round(array_inner_product(q.e, p.e) * 1e9)::BIGINT * 1000000 - p.n) AS top FROM asking q, offered p GROUP BY q.m)
SELECT q.doc_id, q.kind, q.label, q.id AS correct_answer, {_sql_text(templates.LINKING_FEW_SHOT["prefix"])} || chr(10) || {_shot(templates.LINKING_FEW_SHOT["formatter"], "o")} || chr(10) ||
  {_shot(templates.LINKING_FEW_SHOT["suffix"], "q", extracted_component="{0}.label")} AS prompt
FROM asking q JOIN closest b ON b.m = q.m JOIN offered o ON o.n = (1000000 - b.top % 1000000) % 1000000""",
    _CAND_VIEWS,
)
def el_prompts_few_shot(spark):
    """Linking prompts for all components outside a pool of 300 documents, each with a demonstration from the pool."""
    docs = _corpus(spark)
    pool = sampling.sample(docs.select("doc_id"), 300)
    return prompts.el_prompts_with_retrieval(docs, pool, kb_label(spark), templates.LINKING_FEW_SHOT, _letter_counts, parts=_parts(spark, docs))
