"""The derived views on rows of their own."""

from tripleframe.plans.views import COMMON


def test_constraints_of_every_brand(spark):
    own = spark.newSession()
    for name, columns, rows in (
        ("region", "r_regionkey int, r_name string", [(0, "AFRICA")]),
        ("nation", "n_nationkey int, n_name string, n_regionkey int", [(7, "KENYA", 0)]),
        ("supplier", "s_suppkey long, s_nationkey int", [(1, 7)]),
        ("part", "p_partkey long, p_brand string", [(n, f"Brand#{n}") for n in range(1, 7)]),
        ("lineitem", "l_linenumber int, l_suppkey long, l_partkey long", [(6, 1, n) for n in range(1, 7)]),
    ):
        own.createDataFrame(rows, columns).createOrReplaceTempView(name)
    for name in ("fx_kb_constraint", "fx_kb_all_constraints"):
        own.sql(COMMON[name]).createOrReplaceTempView(name)
    found = {(r.property, r.ctype, r.class_id) for r in own.table("fx_kb_all_constraints").collect()}
    for n in range(1, 7):
        assert {(f"LB:Brand#{n}", "range", f"B:Brand#{n}"), (f"LB:Brand#{n}", "domain", "N7")} <= found
    assert ("LB:Brand#5", "domain", "R0") in found and ("L1", "domain", "W0") in found


def test_statements_are_the_same_rows_from_pairs_of_numbers(spark):
    from tripleframe.plans.views import SPARK_ONLY

    own = spark.newSession()
    for name, columns, rows in (
        ("region", "r_regionkey int", [(0,)]),
        ("nation", "n_nationkey int, n_regionkey int", [(7, 0)]),
        ("supplier", "s_suppkey long, s_nationkey int", [(1, 7), (2, None)]),
        ("part", "p_partkey long, p_brand string, p_type string", [(1, "B", "T"), (2, None, None)]),
        ("lineitem", "l_suppkey long, l_partkey long", [(1, 1), (1, 1), (2, 1), (None, 1), (None, 1), (1, None), (None, None)]),
    ):
        own.createDataFrame(rows, columns).createOrReplaceTempView(name)
    texts, pairs = own.sql(COMMON["fx_kb_statement"]), own.sql(SPARK_ONLY["fx_kb_statement"])
    assert sorted(map(str, texts.collect())) == sorted(map(str, pairs.collect()))
    assert "Aggregate [l_suppkey" in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_corpus_brings_line_items_together_once(spark):
    from tripleframe.plans.views import SPARK_CORPUS

    own = spark.newSession()
    for name, columns, rows in (
        ("supplier", "s_suppkey long, s_name string", [(1, "S one"), (2, None)]),
        ("part", "p_partkey long, p_name string", [(40, "rod"), (50, "bolt")]),
        ("lineitem", "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long",
         [(9, 2, 1, 40), (9, 1, 2, 50), (9, 2, 1, 40), (9, None, 1, 50), (9, 1, 3, 40), (9, 1, 1, None), (None, 1, 1, 40), (8, 1, 3, 40)]),
    ):
        own.createDataFrame(rows, columns).createOrReplaceTempView(name)
    made = own.sql(SPARK_CORPUS)
    got = {r.doc_id: r for r in made.collect()}
    assert set(got) == {9, None}
    row = got[9]
    assert (row.title, row.uri, row.split) == ("Order 9", "O9", "train")
    assert row.text == "Order 9 names S one; bolt; bolt; S one; rod; S one; rod."
    one, two, rod, bolt = ("S1", "S one", "ORG"), ("S2", None, "ORG"), ("P40", "rod", "MISC"), ("P50", "bolt", "MISC")
    assert [tuple(e) for e in row.entities] == [one, bolt, two, bolt, one, rod, one, rod]
    assert [(tuple(r.subject), r.predicate, tuple(r.object)) for r in row.relations] == [
        (one, None, bolt), (two, 51 % 32, bolt), (one, 42 % 32, rod), (one, 42 % 32, rod)
    ]
    assert [tuple(e) for e in got[None].entities] == [one, rod] and got[None].relations == []
    # one table of line items, one grouping
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Window" not in plan
