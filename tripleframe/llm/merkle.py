"""A Merkle manifest of a table as a persistent tree: versions share nodes and copy only paths.

1. Every row becomes a leaf, the sha256 of its columns as text (``-`` for NULL, else byte count, ``:``,
   value), and, where a changed text is given, the leaf of the changed row.  Both are column expressions; no
   text goes further than this pass.
2. Leaves are put in order by a range partitioning; sizes of (partition, group) give each leaf its position in its
   group, so a group with a third of all rows is numbered by all tasks.
3. ``WIDTH`` consecutive nodes become their parent.  Aligned blocks of ``WIDTH**LEVELS`` leaves are folded in one
   task each; the roots of the blocks are the leaves of the next stage, until every group has one node.  The
   groups' roots, in group order, are folded the same way to the root of the table.
4. From the top down every block learns the runs of nodes above it, a few hundred bytes a level.
5. A changed leaf makes a version of the tree: a copy of its ancestors, lowest first, and all other nodes shared
   with the first version.  The copies inside a block are made where the block lies, those above it from the
   runs it has learned, so versions go on to the root in as many tasks as there are blocks.  No version meets
   another one and none is built twice.

``doc_id`` is an integer.  Edge cases: NULLs in any column are ``-``; NULL groups are a group, the first one; NULL ids come first,
rows of the same id are ordered by their leaf, repeated rows are leaves of their own; a group of one row has
that leaf as its root; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tripleframe.llm.shared import stored

WIDTH, LEVELS = 16, 2
BLOCK = WIDTH**LEVELS
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def written(value: Column) -> Column:
    """``-`` for NULL, else byte count, ``:``, value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[written(c) for c in columns]), 256))


def _join(nodes: Sequence[bytes]) -> bytes:
    """The parent of a run: digests enter as hexadecimal text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def block_levels(nodes: list[bytes], m: int) -> list[list[bytes]]:
    """The nodes of a block and those above them, level by level; ``m`` nodes of the group lie at its lowest level."""
    levels = [nodes]
    for _ in range(LEVELS):
        if m == 1:
            break
        row = levels[-1]
        levels.append([_join(row[i : i + WIDTH]) for i in range(0, len(row), WIDTH)])
        m = -(-m // WIDTH)
    return levels


def block_path(levels: list[list[bytes]], i: int) -> tuple[list[int], list[bytes]]:
    """Places and runs of the ancestors of node ``i`` inside its block, itself first."""
    places, runs = [], []
    for row in levels[:-1]:
        i, place = divmod(i, WIDTH)
        places.append(place)
        runs.append(b"".join(row[i * WIDTH : (i + 1) * WIDTH]))
    return places, runs


def folded(node: bytes, places: Sequence[int], runs: Sequence[bytes]) -> list[bytes]:
    """The copied ancestors, lowest first, when ``node`` stands in its place of the lowest run."""
    copies = []
    for place, run in zip(places, runs):
        node = _join([run[: 32 * place], node, run[32 * (place + 1) :]])
        copies.append(node)
    return copies


def siblings(places: Sequence[int], runs: Sequence[bytes]) -> bytes:
    return b"".join(run[: 32 * place] + run[32 * (place + 1) :] for place, run in zip(places, runs)).hex().encode()


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``pos`` (from 0) and ``m`` (rows) in their ``key``, in the order of columns that tell all rows apart."""
    dealt = nodes.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    dealt = stored(dealt.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "ranked")
    counts = dealt.groupBy("key", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    # one row per key and partition that holds it
    within = Window.partitionBy("key")
    before = F.sum("n").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("key", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(within).alias("m"))
    return dealt.join(offsets, ["key", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift", *[c for c in order if c == "tie"])


def blocked(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """key, block, m, digests and the carried columns as lists in the order of the nodes; a block holds at most ``BLOCK``."""
    run = F.sort_array(F.collect_list(F.struct("pos", "digest", *carried)))
    held = nodes.groupBy("key", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.max("m").alias("m"), run.alias("run"))
    return held.select("key", "block", "m", *[F.col(f"run.{c}").alias(c) for c in ("digest", *carried)])


def block_roots(blocks: DataFrame) -> DataFrame:
    """The root of every block as a node of the next stage: key, pos, m, digest."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [block_levels(nodes, m)[-1][0] for m, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            above = [-(-m // BLOCK) for m in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(above, pa.int64()), pa.array(roots, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "pos", "m", "digest"])

    return blocks.select("key", "block", "m", "digest").mapInArrow(fold, "key string, pos long, m long, digest binary")


class Tree(NamedTuple):
    """Blocks of every stage, lowest first, and one root per key (key, digest)."""

    stages: list[DataFrame]
    roots: DataFrame


def grown(nodes: DataFrame, carried: Sequence[str] = ()) -> Tree:
    """The first version of the tree over ranked nodes (key, pos, m, digest), written stage by stage."""
    stages = [stored(blocked(nodes, carried), "merkle-blocks")]
    roots = stored(block_roots(stages[0]), "merkle-roots")
    while (roots.agg(F.max("m")).first()[0] or 1) > 1:
        stages.append(stored(blocked(roots), "merkle-blocks"))
        roots = stored(block_roots(stages[-1]), "merkle-roots")
    return Tree(stages, roots.select("key", "digest"))


_PATH = "places array<int>, runs array<binary>, subroot binary"


def paths_below(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """The path of every node of the blocks, from the paths ``above`` (key, pos, places, runs, subroot) of the blocks' roots."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, block, m, nodes, places, runs, subroot in zip(*[c.to_pylist() for c in batch.columns]):
                levels, rows = block_levels(nodes, m), []
                for i in range(len(nodes)):
                    own_places, own_runs = block_path(levels, i)
                    rows.append((key, block * BLOCK + i, own_places + places, own_runs + runs, subroot))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind.field(j).type) for j in range(5)], kind.names)

    kind = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("places", pa.list_(pa.int32())), ("runs", pa.list_(pa.binary())), ("subroot", pa.binary())])
    both = blocks.select("key", "block", "m", "digest").join(above.withColumnRenamed("pos", "block"), ["key", "block"])
    return both.select("key", "block", "m", "digest", "places", "runs", "subroot").mapInArrow(down, f"key string, pos long, {_PATH}")


def _top(keys: DataFrame, subroot: Column) -> DataFrame:
    nothing = F.array().cast("array<int>"), F.array().cast("array<binary>")
    return keys.select("key", F.lit(0).cast("long").alias("pos"), nothing[0].alias("places"), nothing[1].alias("runs"), subroot.alias("subroot"))


class Manifest(NamedTuple):
    """Trees of the groups, the tree over the groups' roots, the paths of the groups, and the root."""

    groups: Tree
    table: Tree
    paths: DataFrame
    root: bytes | None


def manifest(docs: DataFrame, changed_text: Column | None = None, columns: Sequence[str] = LEAF_COLUMNS, group: str = "source", order: str = "doc_id", text: str = "text") -> Manifest:
    """Leaves, in order by group and ``order``, and all nodes above them; ``changed_text`` is NULL where a row stays as it is.

    Keys are the group behind a sign, so that the NULL group, an empty key, comes first in byte order.
    """
    original = leaf([F.col(c) for c in columns])
    changed = F.lit(None).cast("binary")
    if changed_text is not None:
        changed = F.when(changed_text.isNotNull(), leaf([changed_text if c == text else F.col(c) for c in columns]))
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(key.alias("key"), F.col(order).cast("long").alias("doc_id"), original.alias("digest"), changed.alias("changed"), F.monotonically_increasing_id().alias("tie"))
    groups = grown(ranked(stored(leaves, "leaves"), ["doc_id", "digest", "tie"]), ["doc_id", "changed"])
    # the groups' roots are ranked under one key of their own
    subroots = groups.roots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
    placed = stored(ranked(subroots, ["group"]), "subroots")
    table = grown(placed.drop("group"))
    paths = _top(table.roots, F.lit(None).cast("binary"))
    for blocks in reversed(table.stages):
        paths = paths_below(blocks, paths)
    ends = placed.select("pos", F.col("group").alias("key"), F.col("digest").alias("subroot"))
    paths = paths.drop("key", "subroot").join(ends, "pos").select("key", F.lit(0).cast("long").alias("pos"), "places", "runs", "subroot")
    root = table.roots.first()
    return Manifest(groups, table, stored(paths, "group-paths"), bytes(root["digest"]) if root else None)


def versions(made: Manifest) -> DataFrame:
    """One row per leaf: key, pos, doc_id, leaf, subroot, proof (sha256 of the siblings' digests), changed, copies, folded.

    ``copies`` are the ancestors copied for the leaf's version, lowest first, NULL where nothing changed; ``folded``
    is the root of the version, for unchanged leaves the root recomputed from leaf and siblings.  Digests are binary.
    """
    paths = made.paths
    for blocks in reversed(made.groups.stages[1:]):
        paths = paths_below(blocks, paths)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, block, m, nodes, ids, changed, places, runs, subroot in zip(*[c.to_pylist() for c in batch.columns]):
                levels, upper, rows = block_levels(nodes, m), siblings(places, runs), []
                shared = folded(levels[-1][0], places, runs)
                for i, node in enumerate(nodes):
                    own_places, own_runs = block_path(levels, i)
                    proof = hashlib.sha256(siblings(own_places, own_runs) + upper).digest()
                    inside = folded(changed[i] or node, own_places, own_runs)
                    head = (inside or [changed[i] or node])[-1]
                    # a block whose root is that of the first version shares all nodes above it as well
                    copies = inside + (shared if head == levels[-1][0] else folded(head, places, runs))
                    root = (copies or [changed[i] or node])[-1]
                    rows.append((key, block * BLOCK + i, ids[i], node, subroot, proof, changed[i], copies if changed[i] and changed[i] != node else None, root))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind.field(j).type) for j in range(9)], kind.names)

    digests = {c: pa.binary() for c in ("leaf", "subroot", "proof", "changed")}
    kind = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("doc_id", pa.int64()), *digests.items(), ("copies", pa.list_(pa.binary())), ("folded", pa.binary())])
    both = made.groups.stages[0].join(paths.withColumnRenamed("pos", "block"), ["key", "block"])
    found = both.select("key", "block", "m", "digest", "doc_id", "changed", "places", "runs", "subroot").mapInArrow(
        fold, "key string, pos long, doc_id long, leaf binary, subroot binary, proof binary, changed binary, copies array<binary>, folded binary"
    )
    return found.withColumn("root", F.lit(made.root).cast("binary"))


def checked(docs: DataFrame, changed_text: Column | None = None, **options) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row, digests in hexadecimal."""
    rows = versions(manifest(docs, changed_text, **options))
    text = lambda c, name: F.lower(F.hex(c)).alias(name)
    return rows.select(
        "doc_id", text("leaf", "leaf"), text("subroot", "subroot"), text("root", "root"), text("proof", "proof_sha256"),
        text("folded", "folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
