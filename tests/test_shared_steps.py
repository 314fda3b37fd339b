"""Steps that several queries share: what they give and what they no longer move or hold."""

from pyspark.sql import functions as F

from tripleframe.operators import kb, prompts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def statements(spark):
    rows = [("a", "P31", "c1"), ("a", "P31", "c2"), ("a", "P31", None), ("b", "P31", "c1"), ("b", "P31", "c1"), (None, "P31", "c1"),
            ("c1", "P279", "d"), ("c2", "P279", "d"), ("d", "P279", "e"), ("e", "P279", "f")]
    return spark.createDataFrame(rows, "s string, p string, o string")


def test_closures_need_no_comparison_of_their_rows(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("a",), ("z",), (None,)], "id string")
    found = kb.type_closure(ids, statements(spark))
    above = [(1, "d"), (2, "e"), (3, "f")]
    assert sorted(map(tuple, found.collect())) == sorted(
        [("a", 0, "c1"), ("a", 0, "c2"), *(("a", *x) for x in above), ("b", 0, "c1"), *(("b", *x) for x in above)]
    )
    # the outermost step joins ids to what their classes reach; no distinct over the result
    assert "Aggregate [id" not in plan(found)
    merged = kb.merge_types(found, found)
    assert merged.count() == found.count()
    assert "RepartitionByExpression [id" in plan(merged)


def test_types_no_constraint_names_are_left_out_before_the_pairs(spark):
    ids = spark.createDataFrame([("a", "p"), ("b", "p"), ("b", "q")], "id string, property string")
    types = kb.type_closure(ids.select("id"), statements(spark))
    constraints = spark.createDataFrame([("p", "range", "e", "E"), ("p", "domain", "c1", "C")], "property string, ctype string, class_id string, class_label string")
    fits = kb.match_types(ids, types, constraints, "range")
    assert sorted(map(tuple, fits.collect())) == [("a", "p", 2, "e", "E"), ("b", "p", 2, "e", "E")]
    assert "LeftSemi, (class_id" in plan(fits)


def test_candidates_are_joined_after_the_texts(spark):
    labels = spark.createDataFrame([("I1", "item", "Berlin", "a city", 5)], "id string, kind string, label string, description string, popularity int")
    docs = spark.createDataFrame([(1, " On Berlin ")], "doc_id int, text string")
    parts = spark.createDataFrame([(1, "entity", "Berlin", "I1"), (1, "entity", "Nowhere", "I2"), (2, "entity", "Berlin", "I1")], "doc_id int, kind string, label string, correct_answer string")
    made = prompts.el_demonstrations(docs, labels, "string_search", parts=parts)
    rows = {(r.doc_id, r.extracted_component): (r.text, r.candidates) for r in made.collect()}
    assert rows == {(1, "Berlin"): ('"On Berlin"', ["I1 (Berlin): a city"]), (1, "Nowhere"): ('"On Berlin"', None)}
    lines = plan(made).split("\n")
    first = lambda kind: next(i for i, line in enumerate(lines) if f"Join {kind}" in line)
    assert first("LeftOuter") < first("Inner")


def knowledge(spark):
    label = spark.createDataFrame(
        [("a", "item", "A", 1), ("b", "item", "B", 1), ("p", "property", "P", 1)], "id string, kind string, label string, popularity int"
    )
    facts = spark.createDataFrame([("a", "p", "b"), ("a", "p", "b"), ("x", "p", "y")], "s string, p string, o string")
    constraints = spark.createDataFrame(
        [("p", "domain", "e", "E"), ("p", "domain", "e", "D"), ("p", "range", "c1", "C")], "property string, ctype string, class_id string, class_label string"
    )
    return label, statements(spark).unionByName(facts), constraints


def test_checks_fold_no_rows_and_read_their_input_once(spark):
    rows = [("r", "A", "P", "B"), ("r", "A", "P", "B"), ("q", "A", "P", "B"), ("q", "B", "P", "A"), ("q", None, "P", "A"), ("q", "A", None, "zz")]
    triples = spark.createDataFrame(rows, "run string, s string, p string, o string")
    counted = kb.check_counted(triples, *knowledge(spark))
    got = {(r["run"], r["s"], r["p"], r["o"]): r for r in counted.collect()}
    assert len(got) == 5 and {k: r["copies"] for k, r in got.items() if r["copies"] > 1} == {("r", "A", "P", "B"): 2}
    first = got["r", "A", "P", "B"]
    assert first["statement"] and first["level"] == 2 and (first["domain_class"], first["domain_label"], first["range_class"]) == ("e", "D", "c1")
    assert got["q", "B", "P", "A"]["statement"] is False and got["q", None, "P", "A"]["subject_missing"] and got["q", "A", None, "zz"]["level"] is None
    # neither the count of copies nor a fold of the ends of a triple is left in the line of joins
    assert "Aggregate [run" not in plan(counted) and "Aggregate [s#" not in plan(counted) and "Generate" not in plan(counted)
    whole, direct = (kb.check_triples(triples, *knowledge(spark), copies=copies) for copies in (True, False))
    assert whole.columns == direct.columns and direct.count() == 6
    assert sorted(map(str, whole.collect())) == sorted(map(str, direct.collect()))


def test_statements_nobody_asks_for_end_where_they_are_read(spark):
    asked = spark.createDataFrame([("S1", "L1", "P1"), ("S1", "L1", "P2")], "s_id string, p_id string, o_id string")
    pairs = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "l_suppkey long, l_partkey long").distinct()
    facts = pairs.select(F.concat(F.lit("S"), "l_suppkey").alias("s"), F.lit("L1").alias("p"), F.concat(F.lit("P"), "l_partkey").alias("o"))
    held = kb._stated(asked, facts)
    assert [tuple(r) for r in held.collect()] == [("S1", "L1", "P1")]
    lines = plan(held).split("\n")
    # no distinct of statements stands below the semi join
    assert next(i for i, x in enumerate(lines) if "LeftSemi" in x) > max(i for i, x in enumerate(lines) if "Aggregate [" in x)
