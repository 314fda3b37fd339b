"""Trees, proofs and versions against folding whole levels."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tripleframe.llm import merkle as m

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for row in levels[:-1]:
        run = row[i // 16 * 16 : i // 16 * 16 + 16]
        out.append((run, i % 16))
        i //= 16
    return out


def plain(rows, changed):
    """[(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)] and the copies of each."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[name] = tree([leaf_of(r) for r in groups[name]])
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for at, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            steps = path(trees[name], i) + path(top, at)
            proof = digest(x for run, place in steps for j, x in enumerate(run) if j != place)
            node = leaf_of((*row[:4], changed(row)))
            copies = []
            for run, place in steps:
                node = digest([*run[:place], node, *run[place + 1 :]])
                copies.append(node)
            leaf = leaf_of(row)
            out.append((row[0], leaf, trees[name][-1][0], top[-1][0], proof, node, node == top[-1][0], copies))
    return out


def made(sizes, seed=3):
    rng = random.Random(seed)
    rows = []
    for name, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "lower only", f"Some Text {rng.random()} Äß", "ÀÉ"])
            rows.append((rng.randrange(10**6), name, rng.choice([None, "en", "de"]), rng.choice([None, -3, 12]), text))
    return rows


def lowered(row):
    every = row[0] is not None and row[0] % 3 == 0 and row[4] is not None
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4]) if every else row[4]


CHANGED = lambda: F.when(F.col("doc_id") % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize("sizes", [
    {"hot": 700, None: 17, "": 1, "b": 16, "a": 256, "Z": 257, "é": 2},
    {"one": 1},
    {f"source {i}": 1 + i % 3 for i in range(300)},
])
def test_rows_are_those_of_whole_levels(spark, sizes):
    rows = made(sizes)
    rows += [(None, "b", None, None, None), (None, "b", "en", None, "X")] + [rows[0]] * 5 + [(rows[0][0], rows[0][1], "fr", 1, "Tie")] if len(rows) > 1 else []
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({"key": F.lit(1), "digest": F.lit("clash"), "pos": F.lit(0)}).repartition(5)
    want = plain(rows, lowered)
    got = [tuple(r) for r in m.checked(docs, CHANGED()).collect()]
    assert sorted(got, key=repr) == sorted([w[:7] for w in want], key=repr)
    if len(rows) > 1:
        assert 0 < sum(not w[6] for w in want) < len(want)


def test_versions_copy_only_their_path(spark):
    rows = made({"a": 600, "b": 40})
    docs = spark.createDataFrame(rows, COLUMNS)
    found = m.versions(m.manifest(docs, CHANGED())).collect()
    want = {(w[0], w[1]): w[7] for w in plain(rows, lowered)}
    changed = [r for r in found if r["copies"] is not None]
    assert len(changed) == sum(lowered(r) != r[4] for r in rows)
    for r in changed:
        copies = [bytes(c).hex() for c in r["copies"]]
        assert copies == want[r["doc_id"], bytes(r["leaf"]).hex()] and len(copies) == (4 if r["key"] == "=a" else 3)


def test_without_changes_all_proofs_hold(spark):
    docs = spark.createDataFrame(made({"a": 300, "b": 3}), COLUMNS)
    assert m.checked(docs).where("NOT verified").count() == 0


def test_long_text_and_empty_table(spark):
    rows = [(1, "s", "en", 3, "Aé" * 500_000), (2, "s", "en", 3, "b")]
    assert [r["leaf"] for r in m.checked(spark.createDataFrame(rows, COLUMNS)).orderBy("doc_id").collect()] == [leaf_of(r) for r in rows]
    empty = m.checked(spark.createDataFrame([], COLUMNS), CHANGED())
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
