"""Regions of benchmark passages against edit distances of all parts, and awkward inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleframe.llm import decontaminate as d

WORDS = ["tarn", "obel", "qui", "lorem", "stav", "ering", "polk", "weir", "zuma", "hest", "ñandú", "île"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def least_edits(pattern, whole):
    """Fewest edits of the pattern against any part of the text, by the plain table."""
    row = [0] * (len(whole) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, x in enumerate(whole):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def changed(rng, s, n):
    s = list(s)
    for _ in range(n):
        i, kind = rng.randrange(len(s)), rng.randrange(3)
        if kind == 0:
            s[i] = "x"
        elif kind == 1:
            del s[i]
        else:
            s.insert(i, "y")
    return "".join(s)


def test_regions_are_those_within_the_budget():
    rng = random.Random(5)
    items = [(i, text(rng, rng.randint(3, 24))) for i in range(12)]
    index = d.build(items)
    for _ in range(150):
        item, passage = rng.choice(items)
        whole = text(rng, 15) + " " + changed(rng, passage, rng.randint(0, 14)) + " " + text(rng, 15)
        got = {r[0] for r in d.find_all(index, [whole])[0]}
        plain = d.normal(whole)
        want = {
            int(index.items[s]) for s in range(len(index.codes))
            if least_edits("".join(map(chr, index.codes[s])), plain) <= index.budgets[s]
        }
        assert got == want


def test_regions_point_into_the_text_as_given():
    passage = "The weir of Zuma holds seven lamps, and none of them was ever lit by the miller of Hest."
    index = d.build([(7, passage)])
    whole = "Before.\n\n  " + passage.upper().replace(" ", "\t ") + "  after"
    [(item, a, b, edits)] = d.find_all(index, ["", whole])[1]
    assert (item, edits) == (7, 0) and d.normal(whole[a:b]) == d.normal(passage)


def test_part_of_a_long_passage_is_found():
    rng = random.Random(1)
    long = text(rng, 120)
    assert d.find_all(d.build([(1, long)]), [text(rng, 30) + " " + long[200:460] + " " + text(rng, 30)])[0]
    assert not d.find_all(d.build([(1, long)]), [text(rng, 30) + " " + long[200:240] + " " + text(rng, 30)])[0]


@pytest.mark.parametrize("q", [4, 10])
def test_awkward_rows(spark, q):
    passage = "lorem weir zuma hest stav polk obel ering tarn qui lorem stav weir"
    benchmark = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "abc"), (None, passage)], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, passage), (3, passage), (None, "x " + passage.upper()), (5, "clean text"), (6, passage + " filler" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("start", F.lit("clash"))
    found = d.regions(docs, benchmark, q=q)
    assert sorted({str(r["doc_id"]) for r in found.where("item_id = 1").collect()}) == ["3", "6", "None"]
    assert found.where("doc_id = 3 AND item_id = 1").count() == 2
    kept = d.clean(docs, benchmark, q=q)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]
    assert d.regions(docs, benchmark.limit(0)).count() == 0 and d.clean(docs, benchmark.limit(0)).count() == 7
    assert d.regions(docs.limit(0), benchmark).count() == 0


def test_large_benchmark_by_joins(spark):
    """The joined way gives the regions of the index, also for copies, gaps of white space, repeated signs and a frequent passage."""
    rng = random.Random(2)
    common = text(rng, 14)
    items = [(i, text(rng, rng.randint(2, 60)) + (" " + common if i % 2 else "")) for i in range(40)]
    items += [(50, items[3][1]), (50, text(rng, 30)), (None, "-" * 300), (60, None), (61, ""), (62, "abc")]
    rows = [(i, text(rng, 20)) for i in range(10)] + [(10, None), (11, ""), (12, "-" * 4000), (13, common)]
    for i in range(20, 50):
        passage = changed(rng, rng.choice(items[:40])[1], rng.randint(0, 12)).replace(" ", rng.choice([" ", "\n  "]))
        rows.append((i, text(rng, 15) + "  " + passage + " " + text(rng, 9) + " " + passage.upper()))
    rows += [(100 + i, rows[25][1]) for i in range(5)] + [(None, rows[30][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("segment", F.lit(1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("_text_key", F.lit("y"))
    whole = sorted(map(str, d.regions(docs, benchmark).collect()))
    assert len(whole) > 50 and sorted(map(str, d.regions(docs, benchmark, most=100).collect())) == whole
    kept = d.clean(docs, benchmark, most=100)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, d.clean(docs, benchmark).collect()))
    assert d.regions(docs.limit(0), benchmark, most=100).count() == 0


def test_joined_text_in_several_parts(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, text(rng, 20)) for i in range(30)]
    docs = spark.createDataFrame([(1, " and then ".join(t for _, t in items)), (2, items[4][1])], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(d, "SEGMENTS_AT_ONCE", 7)
    want = sorted(map(str, d.regions(docs, benchmark).collect()))
    assert sorted(map(str, d.regions(docs, benchmark, most=100).collect())) == want


def test_most_frequent_grams_are_taken_off_the_need(spark):
    rng = random.Random(3)
    common = text(rng, 12)
    items = [(i, common + " " + text(rng, 14)) for i in range(30)]
    segments = d._segment_table(spark.createDataFrame(items, "item_id long, text string"), d.Q, d.BUDGET).dropDuplicates(["segment"])
    rows = d._seeds(segments, d.Q).groupBy("segment").agg(F.sum("n").alias("n"), F.max("need").alias("need"), F.min("need").alias("low")).collect()
    sizes = {r["segment"]: (len(r["codes"]) // 4 - d.Q + 1, r["budget"]) for r in segments.collect()}
    assert rows and all(r["need"] == r["low"] >= 1 for r in rows)
    for r in rows:
        size, budget = sizes[r["segment"]]
        assert size - r["n"] == size - budget * d.Q - r["need"] <= (size - budget * d.Q) // 2


def test_regions_do_not_depend_on_neighbours():
    rng = random.Random(6)
    items = [(i, text(rng, rng.randint(4, 40))) for i in range(12)]
    index = d.build(items)
    texts = [text(rng, rng.randint(0, 9)) + " " + changed(rng, rng.choice(items)[1], rng.randint(0, 14)) for _ in range(60)]
    assert d.find_all(index, texts) == [d.find_all(index, [t])[0] for t in texts]


def test_alignment_is_the_plain_table():
    rng = random.Random(4)
    for _ in range(100):
        p, t = text(rng, 3), text(rng, 3)
        wide = np.full(len(p) * 3 + len(t) + 2, 0, np.uint32)
        wide[len(p) + 1 : len(p) + 1 + len(t)] = d.signs(t)
        assert d.align(d.signs(p), wide)[0] == least_edits(p, t)


def test_repeated_signs_in_bounded_memory(monkeypatch):
    import tracemalloc

    index = d.build([(1, "-" * 400), (2, "=" * 70 + " end of a rule"), (3, "a passage of plain words that isn't a rule at all")])
    small = "-" * 3000 + " words " + "=" * 900 + " end of a rule, a passage of plain words that isn't a rule at all " + "-" * 2000
    want = d.find_all(index, [small])
    monkeypatch.setattr(d, "PAIRS", 20_000)
    assert d.find_all(index, [small]) == want and {r[0] for r in want[0]} == {1, 2, 3}
    monkeypatch.undo()
    tracemalloc.start()
    found = d.find_all(index, ["-" * 150_000 + " a passage of plain words that isn't a rule at all"])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {r[0] for r in found} == {1, 3} and peak < 600 << 20
