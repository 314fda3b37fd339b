"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find grouping.

1. Every text becomes its set of hashed word shingles.  Texts with equal sets are one class, told apart by a
   128-bit fingerprint and named by their smallest id, so copies cost one row each from here on.
2. SuperMinHash gives a class a signature.  An element offers its j-th rank, a value in [j, j + 1), to the
   j-th place of its own random permutation; levels stop as soon as no slot can improve.
3. Slots in bands of ``rows`` make bucket keys.  In each bucket every class is compared with the smallest
   one, after two filters that lose no link: the set sizes, and the share of equal slots, which for a link
   misses ``estimate`` by chance less than once in ten million.  Where a bucket then holds several groups,
   the classes outside its largest group become satellites of that group; satellites are compared with all
   members and all other satellites, so every pair of the bucket has been looked at, and no pair twice for
   every band it shares.  The comparison is cut into cells of bounded size.  It is made on the signatures first, with the
   filters of 3; only classes left with a possible link travel with their full sets.
4. Links are confirmed on the full sets.  A link with similarity ``threshold`` misses all bands with
   probability (1 - threshold**rows)**(slots / rows), 5e-8 for the defaults.
5. Links are contracted by union-find in every task, then by alternating star steps between tasks.

A satellite meets all members and satellites of its group, also those of other buckets: the work grows with satellites
times members of a group, in cells of bounded size over all tasks.  What travels for it is a signature of one byte a slot.

Ids are integers.  Edge cases: texts without words (NULL, empty, white space) are linked with nothing; rows with a NULL id
take part in no group and are kept; repeated rows fall into one class and each gets its row; an id on
several texts stands for all of them; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tripleframe.llm.shared import stored, unused
from tripleframe.llm.words import mix, odd, shingle_set

SLOTS, ROWS = 128, 4
THRESHOLD = 80  # percent
ESTIMATE = 0.6
CELL = 200_000  # set elements on one side of a cell
SIGNED_CELL = 1024  # signatures on one side of a cell
ELEMENTS = 400_000  # set elements signed at once


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One signature of 32-bit values per non-empty set."""
    sizes = np.array([len(s) for s in sets])
    best = np.full(len(sets) * slots, np.inf)
    owner = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = None
    for level in range(slots):
        draw = mix(element + odd(level))
        place = level + ((draw & np.uint64(0xFFFFFF)) * np.uint64(slots - level) >> np.uint64(24)).astype(np.int64)
        rank = (draw >> np.uint64(24)).astype(np.float64) * 2.0**-40 + level
        if order is None:
            slot = place
        else:
            rows = np.arange(len(element))
            slot = order[rows, place].astype(np.int64)
            order[rows, place] = order[:, level]
        np.minimum.at(best, owner * slots + slot, rank)
        going = best.reshape(-1, slots).max(axis=1) >= level + 1
        if not going.any():
            break
        keep = going[owner]
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (int(keep.sum()), 1))
            rows = np.arange(len(order))
            order[rows, place[keep]] = order[:, 0]
        else:
            order = order[keep]
        owner, element = owner[keep], element[keep]
    bits = mix(best.view(np.uint64)) >> np.uint64(32)
    return bits.astype(np.uint32).reshape(-1, slots)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    n, slots = signatures.shape
    parts = signatures.astype(np.uint64).reshape(n, slots // rows, rows)
    key = np.arange(slots // rows, dtype=np.uint64)[None, :] + np.zeros((n, 1), np.uint64)
    for i in range(rows):
        key = mix(key * odd(0) + parts[:, :, i])
    return key.view(np.int64)


def signed(docs: DataFrame, k: int, slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, print (of the set), keys (of the bands), marks (low byte of every slot)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, sets, held = 0, [], 0
            texts = batch.column(2)
            for i in range(batch.num_rows):
                sets.append(shingle_set(texts[i].as_py(), k))
                held += len(sets[-1])
                if held > ELEMENTS:
                    yield rows_of(batch.slice(start, len(sets)), sets)
                    start, sets, held = i + 1, [], 0
            yield rows_of(batch.slice(start, len(sets)), sets)

    def rows_of(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        signatures = super_minhash(full, slots)
        keys, marks = iter(band_keys(signatures, rows)), iter(signatures.astype(np.uint8))
        columns = [
            batch.column(0),
            batch.column(1),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
            pa.array([next(marks).tobytes() if len(s) else None for s in sets], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "print", "keys", "marks"])

    kind = "doc_id long, text_hash long, n_shingles long, print binary, keys array<long>, marks binary"
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(sign, kind)


def _likely(pairs: DataFrame, classes: DataFrame, threshold: int, estimate: float) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow a link."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("marks").alias(f"{x}_marks"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_sizes_fit(threshold))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = (left == right).mean(axis=1) >= estimate
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "a_marks", "b_marks").mapInArrow(compare, "a long, b long")


def _sizes_fit(threshold: int):
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """rep, n_shingles, shingles of the classes wanted, from the text of the document that names the class."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = shingle_set(batch.column(1)[i].as_py(), k)
                columns = [batch.column(0).slice(i, 1), pa.array([len(found)], pa.int64()), pa.array([found.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "n_shingles", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.select("rep").distinct(), "rep", "left_semi")
    return texts.mapInArrow(to_sets, "rep long, n_shingles long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of class names that reach the threshold on their full sets."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"{x}_set"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                left, right = (np.frombuffer(batch.column(j)[i].as_buffer(), np.uint64) for j in (2, 3))
                common = len(left) + len(right) - len(np.union1d(left, right))
                keep.append(100 * common >= threshold * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "a_set", "b_set").mapInArrow(compare, "a long, b long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(values), columns):
        a, b = np.searchsorted(place, [start, start + columns])
        held = np.zeros((len(left) + len(right), columns), np.float32)
        held[row[a:b], place[a:b] - start] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def _spread(both: DataFrame, weight: str, unit: int) -> DataFrame:
    """The rows ``(group, rep, outside, …)`` once for every cell of their group they take part in, with ``probe`` and ``cell``.

    A side of a cell holds rows of about ``unit`` of ``weight``. Those outside the group are probes in the cells of their row and
    targets in those of their column, the others targets only.
    """
    share = lambda x: F.ceil(F.sum(x) / unit).cast("int")
    blocks = both.groupBy("group").agg(share(F.col(weight)).alias("targets"), F.coalesce(share(F.when(F.col("outside"), F.col(weight))), F.lit(0)).alias("probes"))
    row, column = F.pmod(F.xxhash64("rep"), F.col("probes")), F.pmod(F.xxhash64("rep"), F.col("targets"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    targets = F.transform(upto("probes"), lambda i: F.struct(i.cast("long").alias("i"), column.alias("j"), F.lit(False).alias("probe")))
    probes = F.transform(upto("targets"), lambda j: F.struct(row.alias("i"), j.cast("long").alias("j"), F.lit(True).alias("probe")))
    cells = F.explode(F.when(F.col("outside"), F.concat(targets, probes)).otherwise(targets))
    dealt = both.join(blocks.where("probes > 0"), "group").select(*both.columns, cells.alias("_at"))
    # a cell is a column of its own: rows dealt by their group would otherwise stay together, all cells of a group in one task
    name = F.concat_ws("/", F.col("group").cast("string"), F.col("_at.i").cast("string"), F.col("_at.j").cast("string"))
    return dealt.select(*both.columns, F.col("_at.probe").alias("probe"), name.alias("cell"))


def _linkable(both: DataFrame, ends: DataFrame, threshold: int, estimate: float) -> DataFrame:
    """The rows of ``both`` that sizes and signatures allow a link with one of another root in their group.

    Signatures of a link share ``(1 + threshold) / 2`` of their lowest bits; a share six deviations below that misses a link by chance
    less than once in ten million. Pairs with such a share must also have the share ``estimate`` of equal slots.
    """

    def look(cell: pa.Table) -> pa.Table:
        probe = cell["probe"].to_numpy(zero_copy_only=False)
        rep, root, size = (cell[c].to_numpy() for c in ("rep", "root", "n_shingles"))
        marks = np.frombuffer(b"".join(cell["marks"].to_pylist()), np.uint8).reshape(len(rep), -1)
        slots = marks.shape[1]
        share = (1 + threshold / 100) / 2
        most = slots - int(slots * share - 6 * (slots * share * (1 - share)) ** 0.5)
        bits = np.packbits(marks & 1, axis=1)
        bits = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)
        left, right = np.flatnonzero(probe), np.flatnonzero(~probe)
        alive = np.zeros(len(rep), bool)
        for start in range(0, len(left), 256):
            part = left[start : start + 256]
            unlike = sum(np.bitwise_count(bits[part, i][:, None] ^ bits[right, i][None, :]).astype(np.uint16) for i in range(bits.shape[1]))
            x, y = np.nonzero(unlike <= most)
            x, y = part[x], right[y]
            fit = (root[x] != root[y]) & (np.minimum(size[x], size[y]) * 100 >= np.maximum(size[x], size[y]) * threshold) & ~(alive[x] & alive[y])
            x, y = x[fit], y[fit]
            for at in range(0, len(x), 65_536):
                a, b = x[at : at + 65_536], y[at : at + 65_536]
                keep = (marks[a] == marks[b]).mean(axis=1) >= estimate
                alive[a[keep]] = alive[b[keep]] = True
        return pa.table({"group": cell["group"].filter(pa.array(alive)), "rep": cell["rep"].filter(pa.array(alive))})

    rows = both.join(ends.select("rep", "n_shingles", "marks"), "rep").withColumn("weight", F.lit(1))
    cells = _spread(rows, "weight", SIGNED_CELL).select("cell", "probe", "group", "rep", "root", "n_shingles", "marks")
    found = cells.groupBy("cell").applyInArrow(look, "group long, rep long").distinct()
    return both.join(found, ["group", "rep"], "left_semi")


def _across_groups(
    buckets: DataFrame, found: DataFrame, sets: DataFrame, threshold: int, ends: DataFrame | None = None, estimate: float = ESTIMATE
) -> DataFrame:
    """Links (a, b) between different groups of a bucket; ``ends`` (rep, n_shingles, marks) holds the signature of every set."""
    labelled = buckets.select("rep").distinct().join(found.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = stored(labelled.select("rep", F.coalesce("root", "rep").alias("root")), "labelled")
    sizes = labelled.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    seen = buckets.select("key", "rep").join(labelled.join(sizes, "root"), "rep")
    largest = seen.groupBy("key").agg(F.max(F.struct("size", "root"))["root"].alias("group"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    satellites = seen.join(largest.where("lo < hi"), "key").where("root <> group").select("group", "rep", "root").distinct()
    satellites = stored(satellites, "satellites")
    members = labelled.join(satellites.select(F.col("group").alias("root")).distinct(), "root", "left_semi")
    both = satellites.withColumn("outside", F.lit(True)).unionByName(members.select(F.col("root").alias("group"), "rep", "root", F.lit(False).alias("outside")))
    if ends is not None:
        both = stored(_linkable(both, ends, threshold, estimate), "linkable")

    def compare(cell: pa.Table) -> pa.Table:
        probe = cell["probe"].to_numpy(zero_copy_only=False)
        rep, root = cell["rep"].to_numpy(), cell["root"].to_numpy()
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in cell["shingles"]]
        left, right = np.flatnonzero(probe), np.flatnonzero(~probe)
        found = set()
        for start in range(0, len(left), 512):
            part = left[start : start + 512]
            for other in np.array_split(right, len(right) // 512 + 1):
                if not len(other):
                    continue
                common = common_counts([held[i] for i in part], [held[i] for i in other])
                total = np.array([len(held[i]) for i in part])[:, None] + np.array([len(held[i]) for i in other]) - common
                for x, y in zip(*np.nonzero((100 * common >= threshold * total) & (root[part][:, None] != root[other]))):
                    found.add((rep[part[x]], root[part[x]], root[other[y]]))
        links = [(a, b) for a, own, b in found if own != b]
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    cells = _spread(both.join(sets, "rep"), "n_shingles", CELL).select("cell", "probe", "rep", "root", "shingles")
    return cells.groupBy("cell").applyInArrow(compare, "a long, b long").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """The same groups as stars around their smallest member, found by union-find within each task."""

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.get(top, top) != top:
                top = root[top]
            while root.get(x, x) != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                root.setdefault(a, a)
                root.setdefault(b, b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        rows = [(x, find(x)) for x in root if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(union, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes but the roots.

    Edges hang under smaller nodes.  A step hangs every node under the smallest node that its neighbours know,
    and moves its other neighbours there as well; each step is written, and it ends when nothing moves.
    """
    digest = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    state = stored(contracted(edges), "stars")
    before = digest(state)
    while True:
        both = state.union(state.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        moved = both.join(least, "a").where("b > a AND b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = moved.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
        state = stored(small.select("e.*").where("a <> b").distinct(), "stars")
        now = digest(state)
        if before == now:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def groups(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD, slots: int = SLOTS, rows: int = ROWS, estimate: float = ESTIMATE) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    ``k`` words make a shingle; documents are linked at ``threshold`` percent Jaccard similarity.
    """
    each = stored(signed(docs, k, slots, rows), "signed")
    named = each.where("doc_id IS NOT NULL AND print IS NOT NULL")
    classes = stored(
        named.groupBy("print").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("marks").alias("marks")
        ),
        "classes",
    )
    banded = classes.select("rep", F.explode("keys").alias("key"))
    full = banded.groupBy("key").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    buckets = stored(banded.join(full, "key"), "buckets")
    ends = classes.select("rep", "n_shingles", "marks")
    stars = buckets.where("rep > first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    likely = stored(_likely(stars, ends, threshold, estimate), "likely")
    # the signature of every set that an id in a bucket stands for; rows that repeat count once
    signatures = named.withColumnRenamed("doc_id", "rep").join(buckets.select("rep").distinct(), "rep", "left_semi").groupBy("rep", "print").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("marks").alias("marks"), F.count(F.lit(1)).alias("n")
    )
    signatures = stored(signatures, "signatures")
    sets = _sets(docs, buckets, k)
    sets = stored(sets if signatures.where("n > 1").isEmpty() else sets.dropDuplicates(["rep", "shingles"]), "sets")
    links = stored(_confirmed(likely, sets, threshold), "links")
    found = components(links)
    # a link to a group is written as one to its root
    rest = stored(_across_groups(buckets, found, sets, threshold, signatures, estimate), "rest")
    if not rest.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest))
    member = classes.select("print", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    member = member.select("print", F.coalesce("root", "rep").alias("group"))
    # texts without words get a key of their own, so that they do not meet in one task
    key = F.coalesce(F.col("print"), F.concat(F.lit(b"-"), F.encode(F.col("doc_id").cast("string"), "UTF-8")))
    out = each.withColumn("print", F.when(F.col("doc_id").isNotNull(), key)).join(member, "print", "left")
    group = F.coalesce("group", "doc_id")
    kept = F.coalesce(F.col("doc_id") == group, F.lit(True))
    return out.select("doc_id", "text_hash", "n_shingles", group.alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with one of every group: its smallest id, of repeated rows one."""
    mark, tie = unused("text_hash", docs), unused("no_id", docs)
    found = stored(groups(docs, k, threshold).select("doc_id", F.col("text_hash").alias(mark), "kept"), "groups")
    gone = found.where("NOT kept").select("doc_id", mark).distinct()
    rest = docs.withColumn(mark, F.xxhash64("text")).join(gone, ["doc_id", mark], "left_anti")
    repeated = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id", mark).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        rest = rest.withColumn(tie, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).dropDuplicates(["doc_id", mark, tie]).drop(tie)
    return rest.select(*docs.columns)
