"""Groups against all pairs on full sets; SuperMinHash against its definition and its estimates; awkward rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleframe.llm import neardup as nd
from tripleframe.llm.words import shingle_set


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_set(text, k):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain_groups(rows, k, threshold=80):
    """Smallest reachable id of every row with an id, by comparing all pairs."""
    sets = [(i, plain_set(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def corpus(seed=0):
    """Groups of exact and near copies around the threshold, chains among them, and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, i = [], 0
    for size in (1, 2, 3, 40, 120):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        for _ in range(size):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.02, 0.05, 0.08, 0.1, 0.12]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.1:
                base = copy
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(i + n, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for n in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_groups_are_those_of_all_pairs(spark, k, monkeypatch):
    monkeypatch.setattr(nd, "CELL", 3000)  # several cells
    rows = corpus(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = nd.groups(df, k).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_groups(rows, k)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(plain_set(t, k)) for i, t in rows}


def test_awkward_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text), (3, text), (2, text.upper() + "\n"), (None, text), (None, text), (4, None), (5, ""), (6, " \t "), (7, "word"), (8, "WORD"), (9, "long " + "and longer " * 40_000), (10, "é\x1cb"), (11, "É\x1cb")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit("clash")).withColumn("component_id", F.lit(0))
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in nd.groups(df, 2).collect())
    want = [("10", 10, True), ("11", 11, True), ("2", 2, True), ("3", 2, False), ("3", 2, False), ("4", 4, True), ("5", 5, True), ("6", 6, True), ("7", 7, True), ("8", 7, False), ("9", 9, True)]
    assert got == [*want, ("None", None, True), ("None", None, True)]
    kept = nd.deduplicated(df, 2)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["10", "11", "2", "4", "5", "6", "7", "9", "None", "None"]
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "x y z"), (None, "q"), (None, "q")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in nd.deduplicated(twice).collect()) == ["1", "2", "None", "None"]
    assert nd.groups(df.limit(0), 2).count() == 0 and nd.deduplicated(df.limit(0)).count() == 0


def one_signature(values, slots):
    """The signature's ranks of one set, element by element with a shuffle of its own for each."""
    best = np.full(slots, np.inf)
    for value in values:
        order = list(range(slots))
        for level in range(slots):
            draw = int(nd.mix(np.array([value], np.uint64) + nd.odd(level))[0])
            place = level + ((draw & 0xFFFFFF) * (slots - level) >> 24)
            order[level], order[place] = order[place], order[level]
            best[order[level]] = min(best[order[level]], (draw >> 24) * 2.0**-40 + level)
    return best


def test_signatures_stop_early_without_a_difference():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 7, 40, 300)]
    got = nd.super_minhash(sets, 16)
    for s, row in zip(sets, got):
        bits = nd.mix(one_signature(s, 16).view(np.uint64)) >> np.uint64(32)
        assert row.tolist() == bits.astype(np.uint32).tolist()


def test_estimates_vary_less_than_independent_hashes():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(300):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (40, 10, 10))
        left, right = nd.super_minhash([np.concatenate([common, a]), np.concatenate([common, b])], 128)
        errors.append((left == right).mean() - 40 / 60)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < (40 / 60) * (20 / 60) / 128


def test_components_are_those_of_a_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    assert {r["node"]: r["root"] for r in nd.components(df).collect()} == want


def test_common_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in (5, 30, 50, 0)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert nd.common_counts(sets, sets, columns=16).tolist() == want


def test_shingles_are_the_plain_ones():
    for text in ("A b a B a", "one", "", None, "É é É é", "a  b\x0bc\x0cd e", "x " * 50):
        for k in (1, 2, 5):
            assert len(shingle_set(text, k)) == len(plain_set(text, k))


def test_cells_of_a_group_lie_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(nd, "CELL", 40)
    rng = np.random.default_rng(1)
    sets = [(i, np.unique(rng.integers(0, 50, 20).astype(np.uint64))) for i in range(120)]
    table = spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in sets], "rep long, n_shingles long, shingles binary")
    # one bucket: a group of 60 members and 60 satellites of it
    buckets = spark.createDataFrame([(7, i) for i in range(120)], "key long, rep long")
    found = spark.createDataFrame([(i, 0) for i in range(1, 60)], "node long, root long")
    links = nd._across_groups(buckets, found, table, 80)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cell" in plan and "FlatMapGroupsInArrow [cell" in plan


def test_names_of_helper_columns_may_be_taken(spark):
    rows = [(1, "one text of five words here", 5, "a"), (2, "one text of five words here", 6, "b"), (3, None, 7, "c")]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, _text_hash long, _no_id string")
    got = nd.deduplicated(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == [rows[0], rows[2]]


def counted(monkeypatch):
    """Rows of every table that is written, by its name."""
    counts, write = {}, nd.stored

    def count(df, name):
        out = write(df, name)
        counts.setdefault(name, out.count())
        return out

    monkeypatch.setattr(nd, "stored", count)
    return counts


def test_repeated_rows_have_one_set(spark, monkeypatch):
    rows = corpus(1)
    once = counted(monkeypatch)
    nd.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).count()
    monkeypatch.undo()
    counts = counted(monkeypatch)
    got = nd.groups(spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(5), 2).collect()
    assert len(got) == 3 * len(rows) and {r["doc_id"]: r["component_id"] for r in got} == plain_groups(rows, 2)
    assert counts["sets"] == once["sets"] and counts["likely"] == once["likely"]


def test_only_linkable_classes_travel_with_their_sets(spark, monkeypatch):
    monkeypatch.setattr(nd, "SIGNED_CELL", 16)
    rng = np.random.default_rng(5)
    fresh = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    base = fresh(200)
    near = [np.concatenate([base[:190], fresh(5)]) for _ in range(20)]  # 0.9 alike
    half = [np.concatenate([base[:80], fresh(120)]) for _ in range(60)]  # less than a quarter alike
    sets = [base, *near, *half]
    marks = nd.super_minhash(sets).astype(np.uint8)
    ends = spark.createDataFrame([(i, len(s), marks[i].tobytes()) for i, s in enumerate(sets)], "rep long, n_shingles long, marks binary")
    # ten near ones and all others are satellites of the group of the first
    rows = [(0, i, 0 if i < 11 else i, i >= 11) for i in range(len(sets))]
    both = spark.createDataFrame(rows, "group long, rep long, root long, outside boolean")
    left = {r["rep"] for r in nd._linkable(both, ends, 80, nd.ESTIMATE).collect()}
    assert left == set(range(21))
