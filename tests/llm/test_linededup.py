"""Repeated lines against a plain count."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tripleframe.llm import linededup as d

WHITE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def plain(rows, min_chars=20, min_docs=3):
    """[(doc_id, text, n_lines, n_dropped)] by holding every key in a dictionary."""
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= min_chars and doc_id is not None:
                holders[key_of(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [len(key_of(x)) >= min_chars and len(holders[key_of(x)]) >= min_docs and doc_id != max(holders[key_of(x)]) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((doc_id, None if text is None else kept, len(lines), sum(gone)))
    return out


def made(n, seed=1):
    rng = random.Random(seed)
    lines = [f"line number {i} of the common pool, {'Ä' * (i % 5)}" for i in range(60)] + ["short", "é" * 19, "é" * 20, "İ" + "x" * 19]
    forms = [str, str.upper, lambda x: f" \t{x}\r", lambda x: f"\x0b{x}\x0c", lambda x: x + " "]
    rows = []
    for i in range(n):
        own = [f"only document {i} says this, line {j}" for j in range(rng.randrange(3))]
        text = own + [rng.choice(forms)(rng.choice(lines)) for _ in range(rng.randrange(12))] + [""] * rng.randrange(2)
        rng.shuffle(text)
        rows.append((i * 7 - 50, "\n".join(text)))
    return rows


@pytest.mark.parametrize("shard_keys", [d.SHARD_KEYS, 5])
def test_lines_are_those_of_a_plain_count(spark, shard_keys, monkeypatch):
    monkeypatch.setattr(d, "CHUNK", 500)
    rows = made(150) + [(5000, None), (5001, ""), (None, "line number 1 of the common pool, Ä\nkept line of no id"), (5002, "\n\n")]
    rows += rows[:20] + [(20, rows[3][1]), (20, rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    index = d.indexed(d.repeated_lines(docs), shard_keys)
    assert index.shards == (1 if shard_keys > 100 else index.shards) and (shard_keys > 100 or index.shards > 5)
    got = [tuple(r) for r in d.deduplicated(docs, index=index).collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order(plain(rows))
    assert sum(r[3] for r in got) > 100


def test_other_columns_pass(spark):
    same = "the same line in all of the documents"
    rows = [(i, same, i * 1.5, f"x{i}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_lines double, a string")
    got = d.deduplicated(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "a", "_n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect())) == [(i, "" if i < 3 else same, i * 1.5, f"x{i}", 1, int(i < 3)) for i in range(4)]


def test_hot_line_and_long_text(spark):
    hot = "a licence line that half of all documents hold"
    rows = [(i, f"{hot}\nline of document {i} alone, nobody else") for i in range(400)]
    rows += [(1000, "\n".join([hot, "x" * 300_000, *[f"long text line number {i:06d}" for i in range(50_000)]]))]
    got = {r["doc_id"]: r for r in d.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r["n_dropped"] == (i != 1000) for i, r in got.items())
    assert got[1000]["n_lines"] == 50_002 and hashlib.sha256(got[1000]["text"].encode()).digest() == hashlib.sha256(rows[-1][1].encode()).digest()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert d.deduplicated(empty).count() == 0
    docs = spark.createDataFrame([(1, "no line of this comes back anywhere")], "doc_id long, text string")
    assert d.deduplicated(docs).collect()[0]["n_dropped"] == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_numbers_are_a_permutation(n):
    keys = np.random.default_rng(n).integers(0, 2**63, (n, 2)).astype(np.uint64)
    numbers = d.PerfectHash.of(keys)
    assert np.array_equal(np.sort(numbers.number(keys)), np.arange(n))
    assert sum(numbers.sizes) <= 4 * n + 64 * len(numbers.sizes)
    other = np.random.default_rng(n + 1).integers(0, 2**63, (500, 2)).astype(np.uint64)
    shard = d.Shard(numbers, *[np.empty(n, k) for k in ("<u8", "<u4", "<i8")])
    if n:
        shard.prints[numbers.number(keys)], shard.counts[:] = keys[:, 1], 7
        assert not shard.find(other)[0].any() and (shard.find(keys)[0] == 7).all()
