"""The sorted name index against plain search."""

import random

import numpy as np
import pytest

from tripleframe.operators import linking, names

SCHEMA = "id string, kind string, label string, aliases array<string>, description string, popularity int"


def made(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abÄ￿\U0001f600 #") for _ in range(rng.randrange(1, 6))).strip() or "a"
    rows = [(f"Q{i}", rng.choice(["item", "item", "property"]), word(), rng.choice([None, [], [word(), word()]]), "d", rng.choice([1, 2, 3, None])) for i in range(n)]
    return rows + [(f"S{i}", "item", "same name", ["same name", "same"], "d", 5) for i in range(40)]


def plain(rows, kind, text, k):
    lower = lambda t: t.strip().lower()
    found = []
    for id_, own_kind, label, aliases, _, popularity in rows:
        if own_kind == kind and text:
            own, others = lower(label), [lower(a) for a in aliases or []]
            rank = 1 if own == text else 2 if text in others else 3 if any(n.startswith(text) for n in (own, *others)) else None
            if rank:
                found.append((rank, -popularity if popularity is not None else 99, id_))
    return [(id_, rank) for rank, _, id_ in sorted(found)[:k]]


@pytest.mark.parametrize("part", [names.PART_NAMES, 7])
def test_entries_are_those_of_plain_search(spark, monkeypatch, part):
    monkeypatch.setattr(names, "PART_NAMES", part)
    monkeypatch.setattr(names, "TEXTS", 5)
    rows = made(150, 1)
    index = names.name_index(spark.createDataFrame(rows, SCHEMA))
    assert len(index.firsts) > (20 if part < 10 else 0) and index.firsts == sorted(index.firsts)
    texts = sorted({t for r in rows for n in (r[2], *(r[3] or [])) for t in (n.strip().lower()[:i] for i in range(6))} | {"same name", "same", "zz", "￿", "ä"})
    asked = [(kind, t) for kind in ("item", "property") for t in texts]
    got = {}
    for r in names.best_entries(spark.createDataFrame(asked, "kind string, name string"), index, 4).collect():
        got.setdefault((r["kind"], r["name"]), {})[r["rank"]] = (r["id"], r["match_class"])
    for kind, text in asked:
        found = got.get((kind, text), {})
        assert [found[n] for n in sorted(found)] == plain(rows, kind, text, 4), (kind, text)


def test_short_texts_read_few_names():
    rng = np.random.default_rng(1)
    for n, k in ((100_000, 10), (70_001, 1), (5, 10), (64, 8)):
        ranks = rng.permutation(n) // 3  # three names of each entry
        tree = names.BestInRange(ranks, k)
        for start, stop in [(0, n), (1, n - 1), *(sorted(rng.integers(0, n + 1, 2)) for _ in range(50))]:
            tree.read = 0
            assert np.array_equal(tree.best(start, stop), np.unique(ranks[start:stop])[:k])
            assert tree.read <= 2 * k + 2 * k * max(n.bit_length(), 1)


def test_index_grows_with_the_length_of_the_names(spark):
    label = spark.createDataFrame([(f"Q{i}", "item", f"{i:02d}" + "x" * 1000, None, "d", 1) for i in range(50)], SCHEMA)
    index = names.name_index(label)
    assert index.names.count() == 50
    got = linking.link_labels(spark.createDataFrame([("07",), ("1",), ("07" + "x" * 1000,)], "label string"), label, index=index)
    assert {r["label"][:3]: (r["id"], r["match_class"]) for r in got.collect()} == {"07": ("Q7", 3), "1": ("Q10", 3), "07x": ("Q7", 1)}
