"""Packing and id files against plain tokenizing."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleframe.llm import idfiles, packing
from tripleframe.llm.encode import encoder
from tripleframe.llm.shared import tokenizer_path

TEXTS = [
    None, "", " ", "a  b", " a \n\n b\t", "don't stop. it's", "x\ny. Z!\nw", "é ß 中文 text", "ends.\n", "word " * 3000,
    "The same. The same.", "The same. The same.", "tab\t end", "1.5% of $30,000...", "a\x1c b", "　 wide", "<|endoftext|> x",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i < 11 else 10, t) for i, t in enumerate(TEXTS)] + [(None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash")).withColumn("start", F.lit(1)).repartition(3)


def expected_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [0]


def test_cached_encoding_is_the_librarys():
    for text in TEXTS:
        assert list(np.frombuffer(encoder(tokenizer_path()).encode(text), "<u4")) == expected_ids(text)[:-1], text


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("bits", [False, True])
def test_files_give_back_all_ids_in_order(docs, bits):
    got = [tuple(r) for r in idfiles.read_ids(idfiles.write_ids(docs, tokenizer_path(), bits=bits, block=1000)).collect()]
    rows = [(r["doc_id"], expected_ids(r["text"])) for r in docs.collect()]
    assert sorted((r[0] is not None, r[0] or 0, r[3], bytes(r[4])) for r in got) == sorted(
        (d is not None, d or 0, crc(i), np.array(i, "<u4").tobytes()) for d, i in rows
    )
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == [0, *itertools.accumulate(r[2] for r in got)][:-1]


def test_one_document_can_be_read_alone(docs):
    from pyarrow import fs

    row = idfiles.write_ids(docs.where("doc_id = 9"), tokenizer_path(), block=1000).collect()[0]
    with fs.FileSystem.from_uri(row["folder"])[0].open_input_file(row["path"]) as source:
        assert list(np.frombuffer(idfiles.PlaneReader(source).document(0), "<u4")) == expected_ids("word " * 3000)


def check_places(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_and_places(docs):
    rows = packing.pack(docs, tokenizer_path(), 64).collect()
    check_places(rows, 64)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = []
    for r in docs.collect():
        ids = expected_ids(r["text"])
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        want += [(r["doc_id"] is not None, r["doc_id"] or 0, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert got == sorted(want)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, tokenizer_path()).count() == 0
    assert idfiles.read_ids(idfiles.write_ids(empty, tokenizer_path())).count() == 0


def least_bins(items, capacity):
    """Fewest bins by trying everything."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in sorted({b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values()):
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_reduction_keeps_the_best_packing():
    rng = np.random.default_rng(3)
    for _ in range(150):
        capacity = int(rng.integers(10, 40))
        items = sorted(rng.integers(1, capacity + 1, int(rng.integers(1, 9))).tolist(), reverse=True)
        counts = np.zeros(capacity + 1, np.int64)
        for x in items:
            counts[x] += 1
        fixed = packing.reduce_by_dominance(counts, capacity)
        rest = [int(x) for x in np.repeat(np.arange(capacity + 1), counts)][::-1]
        assert sum(n for _, n in fixed) + least_bins(rest, capacity) == least_bins(items, capacity), (capacity, items, fixed)
