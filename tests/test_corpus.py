"""Document conversion, text renderings and sampling."""

import json
import random

from pyspark.sql import functions as F, types as T

from tripleframe.functions import text
from tripleframe.operators import corpus, sampling

MENTION = "struct<uri:string,surfaceform:string,type:string>"
SCHEMA = (
    f"doc_id int, text string, entities array<{MENTION}>, "
    f"relations array<struct<subject:{MENTION},predicate:bigint,object:{MENTION}>>"
)
BOAT, SEA, FLOAT_, OTHER = ("U1", "Red boat", "MISC"), ("U2", "north sea", "LOC"), ("U3", "FLOATING thing", "Concept"), ("U9", "north sea", "UNK")
EMPTY = ("U4", "", "UNK")
SMALL = ("U5", "éLAN vital", "Concept")


def docs(spark):
    relations = [(BOAT, 19, SEA), (SEA, 0, BOAT), (BOAT, 19, SEA), (SEA, 19, BOAT), (BOAT, 19, SEA)]
    return spark.createDataFrame(
        [(1, "text one", [BOAT, SEA, OTHER, FLOAT_, EMPTY, SMALL, BOAT], relations), (2, "no facts", [], []), (3, "only names", [BOAT], [])],
        SCHEMA,
    )


def test_golden_record(spark):
    got = {r.doc_id: r for r in corpus.convert_documents(docs(spark)).collect()}
    one = got[1]
    assert one["Entities"] == ["Red boat", "north sea", "FLOATING thing", "", "éLAN vital"]
    assert one["Entity Types"] == ["North sea is a/an location.", "Élan vital is a/an concept."]
    assert one["Entity wiki ids"] == ["North sea has a Wikidata ID of U2.", "Élan vital has a Wikidata ID of U5."]
    assert one["Relations"] == ["manufacturer", "country"]
    assert one["Relation wiki ids"] == ["Manufacturer has the Wikidata ID of P176.", "Country has the Wikidata ID of P17."]
    assert [tuple(t) for t in one["Triples"]] == [
        ("Red boat", "Manufacturer", "north sea"), ("north sea", "Country", "Red boat"),
        ("Red boat", "manufacturer", "north sea"), ("north sea", "manufacturer", "Red boat"),
    ]
    assert [tuple(t) for t in one["Wiki Triples"]] == [("U1", "P176", "U2"), ("U2", "P17", "U1"), ("U2", "P176", "U1")]
    true = {tuple(x.lower() for x in t) for t in one["Triples"]}
    assert all(tuple(x.lower() for x in t) not in true for t in one["Corrupted Triples"])
    assert sorted(map(tuple, one["Mixed Triples"])) == sorted(map(tuple, one["Triples"] + one["Corrupted Triples"]))
    for number in (2, 3):
        assert got[number]["Triples"] == [] and got[number]["Corrupted Triples"] == [] and got[number]["Explanations"] == []


def test_unknown_codes(spark):
    df = spark.createDataFrame([("PER", 1), ("XX", 99)], "t string, n int")
    assert [r.x for r in corpus.lookup_type(df, "t", "x", on_missing="null").collect()] == ["Person", None]
    assert [r.x for r in corpus.lookup_relation(df, "n", "x").collect()] == ["place of birth", None]
    try:
        corpus.lookup_type(df, "t", "x").collect()
        raise AssertionError("an unknown type code must be an error")
    except Exception as error:
        assert "unknown entity type: XX" in str(error)


def test_typed_triples(spark):
    row = docs(spark).where("doc_id = 1").select(corpus.typed_id_triples(F.col("relations")).alias("t")).first().t[0]
    assert row.asDict() == {
        "subject": "Red boat", "subject_type": "Miscellaneous", "subject_wikiID": "U1", "predicate": "manufacturer",
        "predicate_wikiID": "P176", "object": "north sea", "object_type": "Location", "object_wikiID": "U2",
    }


STRINGS = ["plain", "it's", 'say "x"', "both ' and \"", "back\\slash", "line\nbreak\ttab\r", "é ü 😀", "", "\x7f{}"]


def test_renderings_match_python(spark):
    df = spark.createDataFrame([(STRINGS, [[s, "x"] for s in STRINGS])], "a array<string>, b array<array<string>>")
    shown = [s for s in STRINGS if "\x7f" not in s]
    rendered = df.select(
        text.list_literal(F.filter("a", lambda s: ~F.contains(s, F.lit("\x7f")))).alias("a"),
        text.json_text(F.col("b"), T.ArrayType(T.ArrayType(T.StringType()))).alias("j"),
    ).first()
    assert rendered.a == str(shown)
    assert rendered.j == json.dumps([[s, "x"] for s in STRINGS])
    kind = T.StructType([T.StructField("t", T.StringType()), T.StructField("n", T.LongType()), T.StructField("m", T.MapType(T.StringType(), T.BooleanType()))])
    record = spark.range(1).select(F.struct(F.lit("ü").alias("t"), F.lit(3).alias("n"), F.create_map(F.lit("k"), F.lit(True)).alias("m")).alias("r"))
    assert record.select(text.json_text(F.col("r"), kind).alias("j")).first().j == json.dumps({"t": "ü", "n": 3, "m": {"k": True}})


def test_names(spark):
    row = spark.range(1).select(
        text.prompt_run_name(F.lit("x/one_prompt.json"), F.lit("d/test.jsonl")).alias("a"),
        text.linking_run_name(F.lit("x/one_prompt.json"), F.lit("d/KE_test.json")).alias("b"),
        text.checked_run_name(F.lit("post_processed_q.json"), "results_from").alias("c"),
        text.id_from_uri(F.lit("http://kb/entity/Q5")).alias("d"),
    ).first()
    assert tuple(row) == ("one_prompts_test", "one_prompts_EL_test", "results_from_q.json", "Q5")


def test_sizes_of_sample_and_split(spark):
    df = spark.range(1001).select(F.col("id").alias("doc_id"), (F.col("id") % 400).alias("body"))
    chosen, rest = sampling.sample_and_rest(df, 50, seed=3, content=["body"])
    picked = {r.body for r in chosen.collect()}
    assert chosen.count() == 50
    assert sorted(r.doc_id for r in rest.collect()) == [i for i in range(1001) if i % 400 not in picked]
    first, second = sampling.shuffle_split(df, 0.3, seed=4)
    a, b = {r.doc_id for r in first.collect()}, {r.doc_id for r in second.collect()}
    assert len(a) == 300 and len(b) == 701 and not a & b
    assert a != set(range(300))
    assert {r.doc_id for r in sampling.shuffle_split(df.repartition(7), 0.3, seed=4)[0].collect()} == a
    assert sampling.shuffle_split(df, 0.0)[0].count() == 0


def test_order_of_ranks(spark):
    from tripleframe.plans.ranking import global_rank

    values = [f"{random.Random(i).randrange(16 ** 8):08x}" for i in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, h string")
    got = {r.i: r["rank"] for r in global_rank(df, "h", ["i"]).collect()}
    expected = {i: n + 1 for n, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert got == expected


def test_samples_are_exact_and_rank_one_bucket(spark):
    import hashlib

    from tripleframe.operators import sampling

    rows = [(i, "x" * 50) for i in range(3000)] + [(7, "copy")] * 20
    df = spark.createDataFrame(rows, "doc_id int, text string")
    order = sorted((i for i, _ in rows), key=lambda i: hashlib.md5(f"13:{i}".encode()).hexdigest())
    for n in (0, 1, 300, 3020, 5000):
        assert sorted(r["doc_id"] for r in sampling.sample(df, n).collect()) == sorted(order[:n])
    first, second = sampling.shuffle_split(df, 0.3)
    assert (first.count(), second.count()) == (906, 2114)
    assert sampling.sample(df.limit(0)).count() == 0
