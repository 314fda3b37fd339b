"""Registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripleframe.llm import ann, centroids, decontaminate, idfiles, linededup, maintext, merkle, neardup, packing, pii, quality, sharding, urls
from tripleframe.llm.shared import new_path, table, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {}


def _query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@_query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of all documents."""
    return quality.scored(table(spark, sf_dir, "documents"))


@_query
def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth vector."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of all pages."""
    return urls.judged(table(spark, sf_dir, "pages"))


@_query
def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for their personal values."""
    key = pii.key_of(spark, corpus_pipeline.PII_KEY)
    found = pii.pseudonymized(table(spark, sf_dir, "documents"), key, count="n_values")
    return found.select("doc_id", "text", "n_values")


@_query
def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written in shards of 1 MiB, small enough that the test tables split too, and read back."""
    docs, folder = table(spark, sf_dir, "documents"), new_path(spark, "shards")
    sharding.write_shards(docs, folder, 1 << 20)
    return sharding.read_shards(spark, folder, docs.schema)


SQL["op5_shards"] = """
WITH sized AS (
  SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents
), up AS (
  SELECT doc_id, bytes, d, h >> (60 - d) AS prefix FROM sized, range(0, 61) t(d)
), node AS (
  SELECT *, sum(bytes) OVER (PARTITION BY d, prefix) AS held, count(*) OVER (PARTITION BY d, prefix) AS n FROM up
), leaf AS (
  SELECT doc_id, bytes, d, prefix, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS k FROM node WHERE held <= 1048576 OR n = 1
)
SELECT doc_id, bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(prefix), CAST(d AS INTEGER), '0') END AS shard, CAST(d AS INTEGER) AS depth FROM leaf WHERE k = 1
"""


@_query
def op6_benchmark_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All regions of documents that hold a benchmark passage."""
    return decontaminate.regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return maintext.extracted(table(spark, sf_dir, "pages"))


@_query
def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@_query
def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as id files in doc_id order, read back."""
    files = idfiles.write_ids(table(spark, sf_dir, "documents"), tokenizer_path())
    return idfiles.read_ids(files, with_ids=False)


@_query
def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: two-word shingles, 80 percent."""
    found = neardup.groups(table(spark, sf_dir, "documents"), k=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


SQL["op10_superminhash"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), members AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS node FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.node) AS component_id, s.doc_id = min(r.node) AS kept
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s
"""


def _lowered(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@_query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, and roots folded from tampered texts where 5 divides the checksum of the id."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, _lowered("text"))
    return merkle.checked(table(spark, sf_dir, "documents"), tampered)


def _merkle_levels(name: str, groups: int) -> str:
    """CTEs ``name``0 to ``name``groups over ``name``0 (g, pos, h, m): every level above, groups of one node staying as they are."""
    level = """
{name}{n} AS (
  SELECT g, pos // 16 AS pos, CASE WHEN m = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, CAST(ceil(m / 16) AS BIGINT) AS m
  FROM {name}{below} GROUP BY g, pos // 16, m
), {name}_run{below} AS (
  SELECT g, pos // 16 AS up, m, string_agg(h, '' ORDER BY pos) AS run FROM {name}{below} GROUP BY g, pos // 16, m
)"""
    return ",".join(level.format(name=name, n=n + 1, below=n) for n in range(groups))


def _merkle_steps(name: str, groups: int, start: str, g: str, pos: str) -> tuple[str, str]:
    """CTEs that carry ``proof`` and ``node`` of the rows of ``start`` up all levels; the last one's name."""
    parts, held = [], start
    for n in range(groups):
        at = f"CAST({pos} // {16 ** n} % 16 AS INTEGER)"
        parts.append(f"""
{name}_up{n} AS (
  SELECT s.* REPLACE (s.proof || CASE WHEN r.m = 1 THEN '' ELSE run[:64 * {at}] || run[64 * {at} + 65:] END AS proof,
    CASE WHEN r.m = 1 THEN s.node ELSE sha256(run[:64 * {at}] || s.node || run[64 * {at} + 65:]) END AS node)
  FROM {held} s JOIN {name}_run{n} r ON r.g = s.{g} AND r.up = s.{pos} // {16 ** (n + 1)}
)""")
        held = f"{name}_up{n}"
    return ",".join(parts), held


_UP, _LAST = _merkle_steps("src", 5, "leafs", "g", "pos")
_UP2, _LAST2 = _merkle_steps("top", 4, "lifted", "one", "place")
_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_HEAD = " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
SQL["op11_merkle"] = f"""
WITH summed AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384))) AS crc FROM documents
), hashed AS (
  SELECT doc_id, source, sha256({_HEAD} || {_PART.format('text')}) AS leaf,
    sha256({_HEAD} || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END END) AS node FROM summed
), leafs AS (
  SELECT doc_id, leaf, node, '' AS proof, coalesce('=' || source, '') AS g, count(*) OVER (PARTITION BY source) AS m,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed
), src0 AS (SELECT g, pos, leaf AS h, m FROM leafs), {_merkle_levels('src', 5)}, {_UP}, top0 AS (
  SELECT 0 AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, h, count(*) OVER () AS m, g AS own FROM src5
), {_merkle_levels('top', 4)}, lifted AS (
  SELECT s.doc_id, s.leaf, t.h AS subroot, s.node, s.proof, 0 AS one, t.pos AS place FROM {_LAST} s JOIN top0 t ON t.own = s.g
), {_UP2}
SELECT s.doc_id, s.leaf, s.subroot, r.h AS root, sha256(s.proof) AS proof_sha256, s.node AS folded_root, s.node = r.h AS verified
FROM {_LAST2} s, top4 r
"""


@_query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors after three rounds."""
    return centroids.with_inertia(centroids.clusters(table(spark, sf_dir, "embeddings")))


def _kmeans_round(n: int) -> str:
    return f"""
near{n} AS (
  SELECT k.row, arg_min(c.j, d.d * 16 + c.j) AS j, min(d.d) AS d
  FROM kept k, center{n} c, LATERAL (SELECT CAST(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS BIGINT) AS d) d
  GROUP BY k.row
), mean{n} AS (
  SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
    SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT a.j, unnest(k.v) AS x, unnest(range(1, 65)) AS i FROM near{n} a JOIN kept k USING (row)) GROUP BY j, i
  ) GROUP BY j
), center{n + 1} AS (SELECT c.j, coalesce(m.v, c.v) AS v FROM center{n} c LEFT JOIN mean{n} m USING (j))"""


SQL["op12_centroids"] = f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), center0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS j, v FROM kept ORDER BY j LIMIT 16
), {_kmeans_round(0)}, {_kmeans_round(1)}, {_kmeans_round(2)}, {_kmeans_round(3)}
SELECT k.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM near3 a JOIN kept k USING (row) JOIN center3 c ON c.j = a.j
"""


@_query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents before and after those that three documents share went."""
    found = linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL["op13_line_dedup"] = """
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT row, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM texts
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), held AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, h.k IS NOT NULL AND l.doc_id IS DISTINCT FROM h.keeper AS gone FROM keyed l LEFT JOIN held h USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row
"""
