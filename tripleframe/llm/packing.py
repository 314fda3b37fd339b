"""Packing of documents into sequences: Martello-Toth dominance reduction, then best fit.

Only the number of pieces of every length matters to the packing, and there are at most ``capacity``
lengths, so the packing is found on that histogram: patterns (which lengths share a sequence) with the
number of their sequences, a few thousand of them at any corpus size.  Spark encodes the texts, counts
the lengths, numbers the pieces of a length and gives every piece its place in a pattern.

Edge cases: NULL and empty texts are documents of the end id alone; repeated rows are packed once each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tripleframe.llm.encode import encoder, with_end
from tripleframe.llm.shared import stored

CAPACITY = 2048

Pattern = tuple[list[tuple[int, int]], int]  # (length, times) in a sequence, number of such sequences


def _largest(counts: np.ndarray, most: int) -> int:
    """The largest length present that is not over ``most``; 0 if there is none."""
    found = np.flatnonzero(counts[: max(most, 0) + 1])
    return int(found[-1]) if found.size else 0


def _best_pair(counts: np.ndarray, room: int) -> tuple[int, int]:
    """Two pieces of largest sum within ``room``, the larger first."""
    best = (0, 0)
    for a in np.flatnonzero(counts[: room + 1])[::-1]:
        a = int(a)
        if 2 * a <= best[0] + best[1]:
            break
        counts[a] -= 1
        b = _largest(counts, min(a, room - a))
        counts[a] += 1
        if b and a + b > best[0] + best[1]:
            best = (a, b)
            if a + b == room:
                break
    return best


def _fix(counts: np.ndarray, lengths: list[int], fixed: list[Pattern]) -> None:
    """Take as many sequences of just these lengths as there are pieces for."""
    times = {x: lengths.count(x) for x in lengths}
    n = min(int(counts[x]) // k for x, k in times.items())
    for x, k in times.items():
        counts[x] -= n * k
    fixed.append((list(times.items()), n))


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix sequences that some best packing holds; ``counts`` is left with the other pieces.

    A set dominates another with the same largest piece if its further pieces can stand in for those of
    the other.  For the largest piece w with room r beside it:
    nothing fits: w alone;  v fills r: {w, v};  no two pieces fit: {w, the largest that fits};
    no three fit and the largest that fits is not under the best pair's sum: {w, that piece};
    no three fit and a pair (a, b) fills r, nothing that fits is over a and nothing lies between b and a: {w, a, b}.
    """
    fixed: list[Pattern] = []
    w = _largest(counts, capacity)
    while w:
        counts[w] -= 1
        room, present = capacity - w, np.flatnonzero(counts)
        smallest = np.repeat(present[:3], np.minimum(counts[present[:3]], 3))[:3]
        v = _largest(counts, room)
        fits = int(np.count_nonzero(np.cumsum(smallest) <= room))
        chosen = None
        if not v:
            chosen = [w]
        elif v == room or fits == 1:
            chosen = [w, v]
        elif fits == 2:
            a, b = _best_pair(counts, room)
            if v >= a + b:
                chosen = [w, v]
            elif a + b == room and v <= a and not counts[b + 1 : a].any():
                chosen = [w, a, b]
        counts[w] += 1
        if chosen:
            _fix(counts, chosen, fixed)
            if counts[w]:
                continue
        w = _largest(counts, w - 1)
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit by falling length; sequences in the same state move together."""
    open_by_room: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 1, bool)

    def put(pattern: list[tuple[int, int]], room: int, n: int) -> None:
        if n:
            open_by_room[room].append((pattern, n))
            rooms[room] = True

    for s in np.flatnonzero(counts)[::-1]:
        s, left = int(s), int(counts[s])
        while left:
            fitting = np.flatnonzero(rooms[s:])
            if fitting.size:
                room = s + int(fitting[0])
                pattern, n = open_by_room[room].pop()
                rooms[room] = bool(open_by_room[room])
            else:
                pattern, n, room = [], left, capacity
            each = min(room // s, left)
            full = min(n, left // each)
            put([*pattern, (s, each)], room - s * each, full)
            if pattern:
                put(pattern, room, n - full)
            left -= full * each
    return [x for entries in open_by_room for x in entries]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    return reduce_by_dominance(counts, capacity) + best_fit(counts, capacity)


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Ranges of pieces of one length (numbered from 0) and where they go, by length and first number."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for pattern, n in patterns:
        at = 0
        for length, times in pattern:
            first = taken.get(length, 0)
            rows.append((length, first, base, times, at))
            taken[length] = first + n * times
            at += length * times
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "times", "at"), table.T))


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with task and number (of its length in its task)."""
    id_type = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        enc, task, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = with_end(enc.encode(text.as_py()))
                n = len(ids) // 4
                stop, piece, start = (n - 1) % capacity + 1, 0, 0
                while start < n:
                    length = stop - start
                    number = seen.get(length, 0)
                    seen[length] = number + 1
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * stop]), task, number))
                    start, stop, piece = stop, stop + capacity, piece + 1
            columns = list(zip(*rows)) or [[]] * 7
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    kind = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, task long, number long"
    return docs.select("doc_id", "text").mapInArrow(cut, kind)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A document's ids end with the end id; longer documents are cut into pieces of ``capacity``, of which the first may be shorter.
    """
    pieces = stored(pieces_of(docs, tokenizer_path, capacity), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # at most one row per length
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(offsets, ["length", "task"]).withColumn("number", F.col("number") + F.col("before"))
    wide = 1 << 48
    key = where["length"] * wide + where["first"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = np.searchsorted(key, b["length"].to_numpy() * wide + b["number"].to_numpy(), "right") - 1
            inside, times = b["number"].to_numpy() - where["first"][k], where["times"][k]
            b["sequence_id"] = where["base"][k] + inside // times
            b["offset"] = where["at"][k] + inside % times * b["length"].to_numpy()
            yield b.drop(columns="number")

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    id_type = dict(docs.dtypes)["doc_id"]
    return numbered.select(*columns, "number").mapInPandas(
        place, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
