"""Token-id files with shuffled planes: write a corpus in document order, read whole or single documents back.

A file holds the ids of a range of documents.  Blocks of ``block`` ids (unsigned 32-bit) are transposed
into byte planes (or bit planes), every plane is compressed with zstandard on its own, and the file ends
with an index of its blocks and of its documents, so any document can be read without the others:

    magic | plane bytes of block 0, 1, ... | index (Arrow stream, zstandard) | index length (8 bytes) | magic

Edge cases: NULL and empty texts are documents of the end id alone; a NULL id sorts first; repeated rows
are written once per row, ties in the id by the hash of their text; an empty table gives no file and no
rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tripleframe.llm.encode import encoder, with_end
from tripleframe.llm.shared import new_path, stored

MAGIC = b"TFPLANE1"
BLOCK = 1 << 16


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, lowest first; all-zero planes at the top are left out."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        planes = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1)
    else:
        planes = np.ascontiguousarray(octets.T)
    used = np.flatnonzero(planes.any(axis=1))
    return [p.tobytes() for p in planes[: used[-1] + 1]] if used.size else []


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    octets = np.zeros((n, 4), np.uint8)
    if bits:
        signs = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            signs[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n)
        octets[:] = np.packbits(signs, axis=1, bitorder="little")
    else:
        for k, plane in enumerate(planes):
            octets[:, k] = np.frombuffer(plane, np.uint8)
    return octets.view("<u4").ravel()


class PlaneWriter:
    """Writes one file; holds at most one block of ids and the sizes of its documents."""

    def __init__(self, out, bits: bool = False, block: int = BLOCK) -> None:
        self.out, self.bits, self.block = out, bits, block
        self.held, self.n_held, self.at, self.blocks, self.doc_ids, self.sizes = [], 0, len(MAGIC), [], [], []
        self.pack = zstandard.ZstdCompressor(level=3).compress
        out.write(MAGIC)

    def add(self, doc_id, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        stop = len(ids) if last else len(ids) - len(ids) % self.block
        for a in range(0, stop, self.block):
            piece = ids[a : min(a + self.block, stop)]
            packed = [self.pack(p) for p in to_planes(piece, self.bits)]
            self.blocks.append({"offset": self.at, "n": len(piece), "planes": [len(p) for p in packed]})
            for p in packed:
                self.out.write(p)
                self.at += len(p)
        self.held, self.n_held = [ids[stop:].tobytes()], len(ids) - stop

    def close(self, id_type: pa.DataType) -> None:
        self._flush(True)
        docs = pa.table({"doc_id": pa.array(self.doc_ids, id_type), "n": pa.array(self.sizes, pa.int64())})
        kind = pa.schema([("offset", pa.int64()), ("n", pa.int64()), ("planes", pa.list_(pa.int64()))])
        index = b""
        for part in (docs, pa.Table.from_pylist(self.blocks, kind)):
            sink = pa.BufferOutputStream()
            meta = {b"bits": str(int(self.bits)).encode()}
            with pa.ipc.new_stream(sink, part.schema.with_metadata(meta)) as stream:
                stream.write_table(part)
            packed = self.pack(sink.getvalue().to_pybytes())
            index += len(packed).to_bytes(8, "little") + packed
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)


class PlaneReader:
    """Reads a file block by block; any document can be read alone."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not an id file")
        n = int.from_bytes(tail[:8], "little")
        index, parts = source.read_at(n, size - 16 - n), []
        while index:
            k = int.from_bytes(index[:8], "little")
            parts.append(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(index[8 : 8 + k])).read_all())
            index = index[8 + k :]
        self.bits = parts[0].schema.metadata[b"bits"] == b"1"
        self.doc_ids, self.sizes = parts[0]["doc_id"].to_pylist(), parts[0]["n"].to_numpy()
        self.blocks = parts[1].to_pylist()
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.block_starts = np.concatenate([[0], np.cumsum([b["n"] for b in self.blocks])]).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        b, planes = self.blocks[k], []
        data, at = self.source.read_at(sum(b["planes"]), b["offset"]) if b["planes"] else b"", 0
        for size in b["planes"]:
            planes.append(zstandard.ZstdDecompressor().decompress(data[at : at + size]))
            at += size
        return from_planes(planes, b["n"], self.bits)

    def documents(self) -> Iterator[bytes]:
        """The ids of every document in order, as bytes, with one block in memory at a time."""
        k, held, at = 0, np.empty(0, "<u4"), 0
        for size in self.sizes:
            parts, need = [], int(size)
            while need:
                if at == len(held):
                    held, at, k = self.block(k), 0, k + 1
                part = held[at : at + need]
                parts.append(part.tobytes())
                at, need = at + len(part), need - len(part)
            yield b"".join(parts)

    def document(self, i: int) -> bytes:
        a, b = int(self.starts[i]), int(self.starts[i + 1])
        first, last = np.searchsorted(self.block_starts, [a, b - 1], "right") - 1
        ids = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return ids[a - self.block_starts[first] : b - self.block_starts[first]].tobytes()


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str | None = None, bits: bool = False, block: int = BLOCK) -> DataFrame:
    """Write all texts as ids in ascending doc_id order; one row per file: file, path, n_docs, n_ids, base.

    ``folder`` must be one that all executors and the driver share.  Every task writes under a name of its own attempt and
    renames the finished file, so a repeated or speculative task leaves the same file.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "ids")
    id_type = pa.string() if dict(docs.dtypes)["doc_id"] == "string" else pa.int64()
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, enc, out = task.partitionId(), encoder(tokenizer_path), None
        files, top = fs.FileSystem.from_uri(folder)
        final = f"{top}/part-{number:06d}.ids"
        draft = f"{top}/.part-{number:06d}-{task.taskAttemptId()}"
        for batch in batches:
            if out is None and batch.num_rows:
                files.create_dir(top, recursive=True)
                out = files.open_output_stream(draft)
                writer = PlaneWriter(out, bits, block)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer.add(doc_id, with_end(enc.encode(text.as_py())))
        if out is not None:
            writer.close(id_type)
            out.close()
            files.move(draft, final)
            yield pa.RecordBatch.from_pylist([{"file": number, "path": final, "n_docs": len(writer.sizes), "n_ids": sum(writer.sizes)}])

    written = stored(ordered.mapInArrow(write, "file long, path string, n_docs long, n_ids long"), "id-index")
    # one row per file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("folder", F.lit(folder))


def read_ids(files: DataFrame, id_type: str = "long", with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                store, _ = fs.FileSystem.from_uri(row.folder)
                with store.open_input_file(row.path) as source:
                    reader, rows, held = PlaneReader(source), [], 0
                    for i, ids in enumerate(reader.documents()):
                        rows.append((reader.doc_ids[i], row.base + int(reader.starts[i]), len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                        held += len(ids) * with_ids + 64
                        if held > 4 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
        return out if id_type == "string" else out.astype({"doc_id": "Int64"})

    spread = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = spread.mapInPandas(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, ids binary")
    return rows if with_ids else rows.drop("ids")
