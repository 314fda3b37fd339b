"""Lines that repeat across documents, found through a sharded minimal perfect hash.

1. A line's key is the line without white space (blank, tab, line ends, vertical tab, form feed) at both ends
   and with A-Z lower-cased.  Keys of at least ``min_chars`` code points are hashed to 128 bits; every
   document counts once for each of its distinct keys.
2. The distinct hashes found in at least ``min_docs`` documents are dealt into shards by their own bits, so
   that shards are even.  In each shard a minimal perfect hash (levels of bit arrays, a key rests on the first
   level where it meets no other) numbers the hashes; the number is the place in three flat arrays: a 64-bit
   fingerprint, the count of documents, and the largest doc_id that holds the line.  Shards are rows of a table.
3. Documents stay where they are.  A task hashes the lines of a chunk of texts, sorts the hashes by shard and
   probes the arrays of one shard after the other; no line is shuffled or joined.  A worker keeps the shards
   it used last, up to ``HELD`` bytes.  A line that is not indexed passes the fingerprint by chance with 2**-64.

Work: one shuffle of (hash, doc_id) rows that is pre-aggregated in the map tasks, and for every chunk of
``CHUNK`` bytes of text one read of the shards of *repeated* lines, 20.5 bytes for each such line.

``doc_id`` is an integer.  Edge cases: a NULL or empty text is one empty line, a NULL text stays NULL; rows with
the same doc_id are one document for the count, each gets its row; a NULL doc_id doesn't count as a document
and loses its repeated lines; an empty table gives no rows; other columns pass through unread.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T

from tripleframe.llm.caches import claim, register
from tripleframe.llm.shared import new_path, stored, unused
from tripleframe.llm.words import mix, odd

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS = 1 << 16
SPARE = 1.5  # bits per key of a level
HELD = 128 << 20
CHUNK = 32 << 20

WHITE = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line in UTF-8; None where it is too short."""
    if len(line) < min_chars:
        return None
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.translate(None, _CONTINUED)) < min_chars:
        return None
    return key


def line_hashes(text: bytes, min_chars: int) -> tuple[int, list[int], list[bytes]]:
    """Number of lines, and place and 128-bit hash of those with a key."""
    lines = text.split(b"\n")
    places, digests = [], []
    for i, line in enumerate(lines):
        key = line_key(line, min_chars)
        if key is not None:
            places.append(i)
            digests.append(xxhash.xxh3_128_digest(key))
    return len(lines), places, digests


def _as_keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _texts(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary())


class PerfectHash:
    """Numbers ``n`` distinct keys (two 64-bit words each) from 0 to n - 1."""

    def __init__(self, words: np.ndarray, sizes: list[int]) -> None:
        self.words, self.sizes = words, sizes
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        drawn = mix(keys[:, 0] ^ mix(keys[:, 1] + odd(level)))
        return ((drawn >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        parts, sizes, left = [], [], keys
        while len(left):
            size = -(-int(SPARE * len(left)) // 64) * 64 or 64
            place = cls.place(left, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[place]]
        return cls(np.concatenate(parts) if parts else np.empty(0, "<u8"), sizes)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key; any number, or -1, for keys that were not numbered."""
        out = np.full(len(keys), -1, np.int64)
        going, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            place = start + self.place(keys[going], level, size)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            set_ = (word >> bit & np.uint64(1)).astype(bool)
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[going[set_]] = (self.before[place >> 6] + np.bitwise_count(below))[set_]
            going, start = going[~set_], start + size
        return out


class Shard(NamedTuple):
    """Arrays of the lines of one shard, by their number."""

    numbers: PerfectHash
    prints: np.ndarray
    counts: np.ndarray
    keepers: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold each line and the largest of them; 0 documents for a line that isn't indexed."""
        at = self.numbers.number(keys)
        known = (at >= 0) & (self.prints[at] == keys[:, 1])
        return np.where(known, self.counts[at], 0), self.keepers[at]

    def size(self) -> int:
        return 2 * self.numbers.words.nbytes + self.prints.nbytes + self.counts.nbytes + self.keepers.nbytes


class LineIndex(NamedTuple):
    """Folder of the shards and their number."""

    folder: str
    shards: int


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys[:, 0] % np.uint64(shards)).astype(np.int64)


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Hashes of the lines in at least ``min_docs`` documents: a, b (halves of the hash), n_docs, keeper."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, repeat = batch.column(0), [], []
            for text in _texts(batch.column(1)):
                digests = set(line_hashes(text.as_py(), min_chars)[2]) if text.is_valid else ()
                found.extend(digests)
                repeat.append(len(digests))
            keys = _as_keys(found).view("<i8")
            owner = ids.take(pa.array(np.repeat(np.arange(len(repeat)), repeat)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), owner], ["a", "b", "doc_id"])

    named = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    held = named.mapInArrow(lines, "a long, b long, doc_id long")
    counted = held.select("a", "b", "doc_id", F.lit(1).cast("long").alias("n"))
    twice = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    if not twice.isEmpty():  # the lines of a document on several rows count once
        extra = held.join(twice, "doc_id", "left_semi").groupBy("a", "b", "doc_id").agg((1 - F.count(F.lit(1))).alias("n"))
        counted = counted.unionByName(extra.where("n < 0"))
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)


def indexed(lines: DataFrame, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """Write the shards of the lines (a, b, n_docs, keeper) to the shared folder."""
    lines = stored(lines, "lines")
    shards = max(1, -(-lines.count() // shard_keys))

    def build(table: pa.Table) -> pa.Table:
        keys = np.stack([table[c].to_numpy().view("<u8") for c in ("a", "b")], axis=1)
        numbers = PerfectHash.of(keys)
        at = numbers.number(keys)
        arrays = {"prints": keys[:, 1], "counts": table["n_docs"].to_numpy().clip(max=2**32 - 1).astype("<u4"), "keepers": table["keeper"].to_numpy()}
        row = {"shard": [table["shard"][0].as_py()], "sizes": [numbers.sizes], "words": [numbers.words.tobytes()]}
        for name, values in arrays.items():
            placed = np.empty_like(values)
            placed[at] = values
            row[name] = [placed.tobytes()]
        return pa.table(row, kind)

    kind = pa.schema([("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("words", "prints", "counts", "keepers")]])
    # the unsigned remainder of the first half, as shard_of takes it
    low, high = F.col("a").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("a", 32)
    dealt = lines.withColumn("shard", ((high % shards) * (2**32 % shards) + low % shards) % shards)
    columns = "shard long, sizes array<long>, words binary, prints binary, counts binary, keepers binary"
    folder = new_path(lines.sparkSession, "line-shards")
    dealt.groupBy("shard").applyInArrow(build, columns).write.partitionBy("shard").parquet(folder)
    return LineIndex(folder, shards)


_SHARDS: OrderedDict[tuple[str, int], Shard | None] = OrderedDict()
register("lines", _SHARDS.clear)


def shard_at(folder: str, number: int) -> Shard | None:
    """A shard from the folder; None where it has no lines.  The ones used last stay in memory."""
    claim("lines")
    name = (folder, number)
    if name in _SHARDS:
        _SHARDS.move_to_end(name)
        return _SHARDS[name]
    files, top = fs.FileSystem.from_uri(folder)
    found = files.get_file_info(fs.FileSelector(f"{top}/shard={number}", allow_not_found=True))
    paths = [f.path for f in found if f.path.endswith(".parquet")]
    shard = None
    if paths:
        with files.open_input_file(paths[0]) as source:
            row = pq.ParquetFile(source).read().to_pylist()[0]
        kinds = {"prints": "<u8", "counts": "<u4", "keepers": "<i8"}
        shard = Shard(PerfectHash(np.frombuffer(row["words"], "<u8"), row["sizes"]), **{c: np.frombuffer(row[c], kind) for c, kind in kinds.items()})
    _SHARDS[name] = shard
    while len(_SHARDS) > 1 and sum(s.size() for s in _SHARDS.values() if s) > HELD:
        _SHARDS.popitem(last=False)
    return shard


def probe(index: LineIndex, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents that hold each line (0 if not indexed) and the largest of them, one shard after the other."""
    counts, keepers = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    shard = shard_of(keys, index.shards)
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        arrays = shard_at(index.folder, int(shard[part[0]])) if len(part) else None
        if arrays is not None:
            counts[part], keepers[part] = arrays.find(keys[part])
    return counts, keepers


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, index: LineIndex | None = None) -> DataFrame:
    """``docs`` with the lines of ``text`` that stay, and n_lines (before), n_dropped.

    Lines found in at least ``min_docs`` documents stay only in the largest doc_id that holds them.  An
    ``index`` of other documents may be given.  Where ``docs`` has a column n_lines or n_dropped, the new one
    starts with an underscore.
    """
    index = index or indexed(repeated_lines(docs, min_chars, min_docs))
    taken = {c.lower() for c in docs.columns}
    names = [unused(c, docs) if c in taken else c for c in ("n_lines", "n_dropped")]
    at = {c: docs.columns.index(c) for c in ("doc_id", "text")}

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(at["text"]).nbytes
            if size > CHUNK:
                yield held
                held, size = [], 0
        if held:
            yield held

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            sizes, places, digests, ids = [], [], [], []
            for batch in chunk:
                for doc_id, text in zip(batch.column(at["doc_id"]).to_pylist(), _texts(batch.column(at["text"]))):
                    n, place, found = line_hashes(text.as_py() or b"", min_chars)
                    sizes.append(n)
                    places.append(place)
                    digests.extend(found)
                    ids.append(doc_id)
            counts, keepers = probe(index, _as_keys(digests))
            repeat = [len(p) for p in places]
            foreign = np.repeat(np.array([i is None for i in ids], bool), repeat) | (np.repeat(np.array([i or 0 for i in ids], np.int64), repeat) != keepers)
            gone, first, row = (counts >= min_docs) & foreign, 0, 0
            for batch in chunk:
                texts, n_dropped = [], []
                for text in _texts(batch.column(at["text"])):
                    flags = gone[first : first + repeat[row]]
                    dropped = {places[row][i] for i in np.flatnonzero(flags)}
                    value = text.as_py()
                    if dropped:
                        value = b"\n".join(line for i, line in enumerate(value.split(b"\n")) if i not in dropped)
                    texts.append(value)
                    n_dropped.append(len(dropped))
                    first, row = first + repeat[row], row + 1
                columns = list(batch.columns)
                columns[at["text"]] = pa.array(texts, pa.binary()).cast(batch.schema.field(at["text"]).type, safe=False)
                lines = pa.array(sizes[row - batch.num_rows : row], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, lines, pa.array(n_dropped, pa.int64())], [*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in names]])
    return docs.mapInArrow(cut, schema)
