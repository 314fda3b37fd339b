"""Benchmark passages in documents: q-gram lemma filtering, verified by banded alignment.

Texts and passages are lower-cased and white space becomes one blank.  Passages are cut into overlapping
segments.  A region within ``k`` edits of a segment of m signs shares at least m - q + 1 - k * q of its
q-grams with it, all on neighbouring diagonals.  Shared q-grams are counted in overlapping bands of
diagonals, each as wide as two budgets, so every such region is whole in one band; bands that reach the
bound are aligned with the segment inside the band, and regions within the budget stay.

A benchmark of up to ``BLOCK_SIGNS`` signs is one index that all tasks hold, and no document is shuffled.  A larger one
stays a table: distinct segments, their q-grams without the most frequent ones (up to half of what a region must share), and
a bitmap of the others of at most 64 MB.  Every distinct text sends its q-grams in the bitmap once, they meet the
segments by a join, and the pairs of text and segment that share enough are searched as above, so both ways give the same
regions.  Only texts with such a pair are shuffled.

Edge cases: NULL and empty texts have no regions, NULL or empty passages and passages under q signs find
nothing; for short segments the budget is lowered until the bound is at least 1; repeated rows and copies
of a passage give their own regions; empty tables on either side give no regions; other columns are not
read by ``regions`` and pass through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tripleframe.llm.shared import stored, unused

Q = 10
BUDGET = 0.08  # edits per sign of a segment
SEGMENT, STEP = 160, 80
BLOCK_SIGNS = 1_000_000  # signs of passages held as one index
MOST_BITS = 29  # of the bitmap
SEGMENTS_AT_ONCE = 10_000  # segments that a text is searched for in one group
CHUNK = 2_000_000  # signs of documents looked at together
PAIRS = 1_000_000  # q-gram places of text and segments compared at once
REACH = 2 * SEGMENT  # signs within which all pairs of a band lie
_BITS = 22
_NO_ID = -(1 << 63)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    lower = (text or "").lower()
    if text and len(lower) != len(text):  # the few signs whose lower case is longer keep their place
        lower = "".join(c.lower()[:1] for c in text)
    return " ".join(lower.split())


def signs(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = codes[:n].astype(np.uint64)
    for i in range(1, q):
        out *= _STEP
        out += codes[i : n + i]
    out ^= out >> np.uint64(29)
    out *= _STEP
    return out


@dataclass
class Index:
    """Segments of a block of passages and the places of their q-grams."""

    items: np.ndarray  # item of each segment
    codes: list[np.ndarray]
    budgets: np.ndarray
    bounds: np.ndarray  # q-grams that a region must share
    values: np.ndarray  # sorted distinct q-grams
    first: np.ndarray  # places of a q-gram: [first[i], first[i + 1]) in segment, place
    segment: np.ndarray
    place: np.ndarray
    q: int

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.values >> np.uint64(64 - _BITS)).astype(np.int64)] = True


def segments_of(text: str | None, q: int, budget: float) -> list[tuple[np.ndarray, int]]:
    """Signs and budgets of the segments of a passage."""
    whole = signs(normal(text))
    parts = [whole[max(0, min(a, len(whole) - SEGMENT)) : a + SEGMENT] for a in range(0, max(1, len(whole) - SEGMENT + STEP), STEP)]
    return [(p, min(int(len(p) * budget), (len(p) - q) // q)) for p in parts if len(p) >= q]


def build(items: list[tuple[int, str | None]], q: int = Q, budget: float = BUDGET) -> Index:
    return index_of([(_NO_ID if item is None else item, *part) for item, text in items for part in segments_of(text, q, budget)], q)


def index_of(segments: list[tuple[int, np.ndarray, int]], q: int) -> Index:
    """The index of segments, given with their items and budgets."""
    codes = [c for _, c, _ in segments]
    found = [grams(c, q) for c in codes]
    sizes = [len(f) for f in found]
    value = np.concatenate(found) if found else np.empty(0, np.uint64)
    segment = np.repeat(np.arange(len(codes)), sizes)
    place = np.concatenate([np.arange(n) for n in sizes]) if found else np.empty(0, np.int64)
    order = np.argsort(value, kind="stable")
    values, first = np.unique(value[order], return_index=True)
    budgets = np.array([b for _, _, b in segments], np.int64)
    items = np.array([i for i, _, _ in segments], np.int64)
    return Index(items, codes, budgets, np.array(sizes, np.int64) - budgets * q, values, np.append(first, len(value)), segment[order], place[order], q)


def candidates(index: Index, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments and first diagonals of the bands that share enough q-grams, of the texts that start at ``starts``.

    Bands count from the start of each text, so what is found doesn't depend on the texts it is searched with.

    Where q-grams repeat in text and segments, their pairs are formed in windows of the text.  All pairs of a band lie
    within ``REACH`` signs, by which windows overlap, so each band is whole in one of them.
    """
    value = grams(codes, index.q)
    at = np.flatnonzero(index.seen[(value >> np.uint64(64 - _BITS)).astype(np.int64)])
    slot = np.searchsorted(index.values, value[at])
    slot[slot == len(index.values)] = 0
    hit = index.values[slot] == value[at] if len(index.values) else np.zeros(len(at), bool)
    at, slot = at[hit], slot[hit]
    pairs = np.cumsum(index.first[slot + 1] - index.first[slot])
    if not len(pairs) or pairs[-1] <= PAIRS:
        return _bands(index, len(codes), starts, at, slot)
    found, start = [], 0
    while start < len(at):
        done = pairs[start - 1] if start else 0
        stop = max(int(np.searchsorted(pairs, done + PAIRS, "right")), int(np.searchsorted(at, at[start] + 2 * REACH)), start + 1)
        found.append(np.stack(_bands(index, len(codes), starts, at[start:stop], slot[start:stop])))
        if stop >= len(at):
            break
        apart = at[stop] - at[stop - 1] >= REACH
        start = stop if apart else int(np.searchsorted(at, at[stop - 1] - REACH + 1))
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def _bands(index: Index, length: int, starts: np.ndarray, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bands with enough of the q-grams at the places ``at`` of texts of ``length`` signs in all."""
    n = index.first[slot + 1] - index.first[slot]
    entry = np.repeat(index.first[slot] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    segment = index.segment[entry]
    text = np.repeat(starts[np.searchsorted(starts, at, "right") - 1], n)
    width = 2 * index.budgets[segment] + 1
    # texts lie ``SEGMENT`` signs apart, so bands numbered from their starts are different ones
    band = text + (np.repeat(at, n) - text - index.place[entry] + SEGMENT) // width
    wide = length + 2 * SEGMENT
    key = np.concatenate([segment * wide + band, segment * wide + band - 1])
    own, where = np.concatenate([index.place[entry]] * 2), np.concatenate([np.repeat(at, n)] * 2)
    for turn in range(3):  # all shared q-grams, then each place of the segment once, then each of the text
        places = (None, own, where)[turn]
        if places is None:
            once = np.arange(len(key))
        else:
            order = np.lexsort((places, key))
            new = np.ones(len(key), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (places[order][1:] != places[order][:-1])
            once = order[new]
        keys, counts = np.unique(key[once], return_counts=True)
        keys = keys[counts >= index.bounds[keys // wide]]
        kept = np.zeros(len(key), bool) if not len(keys) else keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
        key, own, where = key[kept], own[kept], where[kept]
    segment, band = keys // wide, keys % wide
    text = starts[np.searchsorted(starts, band, "right") - 1]
    # a band before the first one is that of the last place before its text; it holds no more than the first one
    real = (band < wide - 1) & ~np.isin(band + 1, starts)
    segment, band, text = segment[real], band[real], text[real]
    return segment, text + (band - text) * (2 * index.budgets[segment] + 1) - SEGMENT


def align(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Fewest edits of the pattern against any part of the text, and where that part ends.

    ``text`` holds the signs of a band: row i of the pattern meets its signs i to i + width only.
    """
    m = len(pattern)
    width = len(text) - m + 1
    ramp = np.arange(width)
    row = np.zeros(width, np.int64)
    for i in range(m):
        down = np.append(row[1:], m) + 1  # a sign of the pattern is missing in the text
        here = np.minimum(row + (text[i : i + width] != pattern[i]), down)
        row = np.minimum.accumulate(here - ramp) + ramp  # a sign of the text is extra
    best = int(row.argmin())
    return int(row[best]), m + best


def _verified(index: Index, codes: np.ndarray, segment: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    found = []
    for s, d in zip(segment.tolist(), first.tolist()):
        pattern, k = index.codes[s], int(index.budgets[s])
        a, b = d, d + 2 * (2 * k + 1) + len(pattern)
        window = np.full(b - a, 0xFFFFFFFF, np.uint32)
        lo, hi = max(a, 0), min(b, len(codes))
        if hi <= lo:
            continue
        window[lo - a : hi - a] = codes[lo:hi]
        exact = window.tobytes().find(pattern.tobytes())
        if exact >= 0 and exact % 4 == 0:
            found.append((int(index.items[s]), a + exact // 4, a + exact // 4 + len(pattern), 0))
            continue
        edits, end = align(pattern, window)
        if edits <= k:
            back = window[max(0, end - len(pattern) - k) : end][::-1]
            padded = np.full(len(pattern) + 2 * k + 1, 0xFFFFFFFF, np.uint32)
            padded[: len(back)] = back
            found.append((int(index.items[s]), a + end - _used(pattern[::-1], padded), a + end, edits))
    return found


def _used(pattern: np.ndarray, text: np.ndarray) -> int:
    """How many signs of the text, from its first, align best with the pattern (reversed: finds a region's start)."""
    m, n = len(pattern), len(text)
    ramp = np.arange(n + 1)
    row = ramp.copy()
    for c in pattern:
        here = row + 1
        here[1:] = np.minimum(here[1:], row[:-1] + (text != c))
        row = np.minimum.accumulate(here - ramp) + ramp
    return int(row[: m * 2].argmin())


def _merged(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Overlapping regions of an item become one; its edits are those of the best part."""
    out: list[tuple[int, int, int, int]] = []
    for item, a, b, edits in sorted(set(found)):
        if out and out[-1][0] == item and a <= out[-1][2]:
            last = out.pop()
            out.append((item, last[1], max(b, last[2]), min(edits, last[3])))
        else:
            out.append((item, a, b, edits))
    return out


def find_all(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """The regions of every text, in signs of the text as given."""
    found = find_normal(index, texts)
    return [[(i, *_original(t, a, b), e) for i, a, b, e in own] if own else own for t, own in zip(texts, found)]


def find_normal(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """The regions of every text, in signs of its normal form; texts are looked at in chunks of ``CHUNK`` signs."""
    out: list[list[tuple[int, int, int, int]]] = []
    held: list[str] = []

    def flush() -> None:
        # no passage holds a line end, so no q-gram over a border of two texts is shared
        starts = np.cumsum([0, *(len(t) + SEGMENT for t in held[:-1])])
        codes = signs(("\n" * SEGMENT).join(held))
        by_text: list[list] = [[] for _ in held]
        for item, a, b, edits in _verified(index, codes, *candidates(index, codes, starts)):
            k = int(np.searchsorted(starts, max(a, 0), "right")) - 1
            by_text[k].append((item, max(a - int(starts[k]), 0), min(b - int(starts[k]), len(held[k])), edits))
        out.extend(_merged(x) for x in by_text)
        held.clear()

    size = 0
    for text in texts:
        plain = normal(text)
        if size and size + len(plain) > CHUNK:
            flush()
            size = 0
        held.append(plain)
        size += len(plain) + SEGMENT
    if held:
        flush()
    return out


def _original(text: str, a: int, b: int) -> tuple[int, int]:
    """A range of the normal form as a range of the text."""
    places = [i for i, c in enumerate(text) if not c.isspace() or (i and not text[i - 1].isspace())]
    lead = len(text) - len(text.lstrip())
    places = [i for i in places if i >= lead]
    return places[min(a, len(places) - 1)], places[min(b, len(places)) - 1] + 1


def small_benchmark(benchmark: DataFrame, q: int, most: int) -> list[tuple[int | None, str]] | None:
    """The passages, if they have at most ``most`` signs in all; those under q signs find nothing."""
    long = benchmark.where(F.length("text") >= q).select(F.col("item_id").cast("long"), "text")
    size = long.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return [tuple(r) for r in long.collect()] if size <= most else None


def regions(docs: DataFrame, benchmark: DataFrame, q: int = Q, budget: float = BUDGET, most: int = BLOCK_SIGNS) -> DataFrame:
    """doc_id, item_id, start, end, edits of every region of a document that holds (a segment of) a passage."""
    kind = "doc_id long, item_id long, start long, end long, edits long"
    items = small_benchmark(benchmark, q, most)
    if items is None:
        keyed = docs.select(F.col("doc_id").cast("long"), F.md5("text").alias("key"))
        return keyed.join(_merged_by_text(*_joined(docs, benchmark, q, budget)), "key").drop("key")
    index = build(items, q, budget)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(d, None if r[0] == _NO_ID else r[0], *r[1:]) for d, own in zip(ids, find_all(index, batch.column(1).to_pylist())) for r in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["doc_id", "item_id", "start", "end", "edits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, kind)


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, budget: float = BUDGET, most: int = BLOCK_SIGNS) -> DataFrame:
    """The rows of ``docs`` without any such region."""
    items = small_benchmark(benchmark, q, most)
    if items is None:
        key = unused("text_key", docs)
        gone = _joined(docs, benchmark, q, budget)[0].select(F.col("key").alias(key)).distinct()
        return docs.withColumn(key, F.md5("text")).join(gone, key, "left_anti").select(*[docs[c] for c in docs.columns])
    index = build(items, q, budget)

    @F.pandas_udf("boolean")
    def free(texts: pd.Series) -> pd.Series:
        return pd.Series([not r for r in find_all(index, texts.tolist())], dtype=bool)

    return docs.where(free("text"))


def _segment_table(benchmark: DataFrame, q: int, budget: float) -> DataFrame:
    """item_id, segment (key of its signs), codes, budget of every segment."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, c.tobytes(), b) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c, b in segments_of(t, q, budget)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "codes", "budget"])

    long = benchmark.where(F.length("text") >= q).select(F.col("item_id").cast("long"), "text")
    return long.mapInArrow(cut, "item_id long, codes binary, budget int").withColumn("segment", F.md5("codes"))


def _seeds(segments: DataFrame, q: int) -> DataFrame:
    """gram, segment, n, need: a region of a segment shares ``need`` of these q-grams with it, each up to ``n`` times.

    A region shares ``bound`` q-grams.  The most frequent ones of a segment, up to half of the bound, are left out and taken
    off the need, so that q-grams in very many segments multiply few rows.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(grams(np.frombuffer(c, "<u4"), q), return_counts=True) for c in batch.column(1).to_pylist()]
            sizes = [len(g) for g, _ in found]
            bounds = [int(n.sum()) - q * b for (_, n), b in zip(found, batch.column(2).to_pylist())]
            gram = np.concatenate([g for g, _ in found]).view(np.int64) if found else np.empty(0, np.int64)
            times = np.concatenate([n for _, n in found]) if found else np.empty(0, np.int64)
            row = np.repeat(np.arange(len(found)), sizes)
            columns = [pa.array(gram), batch.column(0).take(pa.array(row)), pa.array(times.astype(np.int64)), pa.array(np.array(bounds, np.int64)[row])]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "segment", "n", "bound"])

    every = stored(segments.select("segment", "codes", "budget").mapInArrow(expand, "gram long, segment string, n long, bound long"), "grams")
    frequent = every.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    own = Window.partitionBy("segment")
    ranked = every.join(frequent, "gram").withColumn("taken", F.sum("n").over(own.orderBy(F.desc("held"), "gram")))
    left_out = F.max(F.when(F.col("taken") <= F.expr("bound div 2"), F.col("taken"))).over(own)
    needed = ranked.withColumn("need", F.col("bound") - F.coalesce(left_out, F.lit(0)))
    return needed.where(F.col("taken") > F.expr("bound div 2")).select("gram", "segment", "n", "need")


def _bitmap(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """One bit per first bits of a q-gram, about 16 bits a q-gram but at most 2**``MOST_BITS``; and how many bits are looked at."""
    count = seeds.agg(F.approx_count_distinct("gram")).first()[0]
    bits = min(MOST_BITS, max(_BITS, (16 * count).bit_length()))
    slots = seeds.select(F.shiftrightunsigned("gram", 64 - bits).alias("slot")).distinct()

    def pack(rows: pa.Table) -> pa.Table:
        slot = rows["slot"].to_numpy()
        held = np.zeros(1 << 16, np.uint8)
        held[slot & 0xFFFF] = 1
        return pa.table({"page": pa.array([slot[0] >> 16], pa.int64()), "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})

    # pages of 8 KB, one in the driver's hands at a time
    pages = slots.groupBy(F.shiftright("slot", 16)).applyInArrow(pack, "page long, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in pages.toLocalIterator():
        out[row["page"] << 13 : (row["page"] + 1) << 13] = np.frombuffer(row["bits"], np.uint8)
    return out, bits


def _joined(docs: DataFrame, benchmark: DataFrame, q: int, budget: float) -> tuple[DataFrame, DataFrame]:
    """key (of a text), segment and the region of the segment in that text; and the items of segments."""
    table = stored(_segment_table(benchmark, q, budget), "segments")
    segments = stored(table.dropDuplicates(["segment"]).drop("item_id"), "segments")
    seeds = stored(_seeds(segments, q), "seeds")
    bitmap, bits = _bitmap(seeds)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The q-grams of each text that the bitmap holds, sent on a million at a time."""
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = grams(signs(normal(text.as_py())), q)
                slot = (value >> np.uint64(64 - bits)).astype(np.int64)
                own, n = np.unique(value[(bitmap[slot >> 3] >> (7 - (slot & 7))) & 1 == 1], return_counts=True)
                if len(own):
                    rows.append((key, own.view(np.int64), n))
                    held += len(own)
                if held >= PAIRS:
                    yield sent(rows)
                    rows, held = [], 0
            yield sent(rows)

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        numbers = pa.list_(pa.int64())
        columns = [pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], numbers) for i in (1, 2)]]
        return pa.RecordBatch.from_arrays(columns, ["key", "gram", "times"])

    texts = docs.where(F.length("text") >= 1).select(F.md5("text").alias("key"), "text")
    hits = texts.mapInArrow(seen, "key string, gram array<long>, times array<long>").dropDuplicates(["key"])
    hits = hits.select("key", F.explode(F.arrays_zip("gram", "times")).alias("h")).select("key", "h.gram", "h.times")
    shared = hits.join(seeds, "gram").groupBy("key", "segment", "need").agg(F.sum(F.least("times", "n")).alias("shared"))
    pairs = stored(shared.where("shared >= need").select("key", "segment"), "pairs")
    dealt = stored(pairs.groupBy("key").agg((F.count(F.lit(1)) / SEGMENTS_AT_ONCE + 1).cast("int").alias("parts")), "parts")
    wanted = pairs.join(dealt, "key").withColumn("part", F.pmod(F.xxhash64("segment"), F.col("parts")).cast("int"))
    wanted = wanted.join(segments, "segment").select("key", "part", "segment", "codes", "budget")
    asked = texts.join(dealt, "key").dropDuplicates(["key"])
    asked = asked.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text")

    def search(rows: pa.Table, own: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and own.num_rows:
            key, text, names = rows["key"][0].as_py(), rows["text"][0].as_py(), own["segment"].to_pylist()
            parts = zip(own["codes"].to_pylist(), own["budget"].to_pylist())
            index = index_of([(i, np.frombuffer(c, "<u4"), b) for i, (c, b) in enumerate(parts)], q)
            out = [(key, names[i], a, b, *_original(text, a, b), e) for i, a, b, e in find_normal(index, [text])[0]]
        types = [pa.string()] * 2 + [pa.int64()] * 5
        return pa.table({n: pa.array([r[i] for r in out], types[i]) for i, n in enumerate(("key", "segment", "a", "b", "start", "end", "edits"))})

    both = asked.groupBy("key", "part").cogroup(wanted.groupBy("key", "part"))
    found = both.applyInArrow(search, "key string, segment string, a long, b long, start long, end long, edits long")
    return stored(found, "found"), table.select("item_id", "segment").distinct()


def _merged_by_text(found: DataFrame, items: DataFrame) -> DataFrame:
    """key, item_id, start, end, edits: overlapping regions of an item in a text become one, as by ``_merged``."""
    order = Window.partitionBy("key", "item_id").orderBy("a", "b")
    reached = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.join(items, "segment").withColumn("new", F.when(F.col("a") > reached, 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("key", "item_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits")).drop("run")
