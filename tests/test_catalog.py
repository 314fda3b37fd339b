"""Every registered query against its SQL on the smallest tables, and partition counts."""

import os

import pytest

from compare import bag, compare, duck
from tripleframe.plans.catalog import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    ok, message, _ = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert ok, message


@pytest.mark.parametrize("name", ["run_scores", "kb_summary", "split", "candidates_text"])
def test_partition_count_does_not_matter(spark, name):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 30):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            df = QUERIES[name](spark, SF)
            seen.append(bag(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_cascade_over_texts_of_every_format(spark):
    """The SQL of ``read_documents`` on texts that its pattern readers find something in, or nearly."""
    import duckdb
    import pandas as pd

    from tripleframe.plans.catalog import extraction

    texts = [
        "plain", None, "", "1. a - b - c\n2. d - e", "see (a, b, c) and (d ,e, f)", "(a,\n b, c)", '("a", "b", "c")', "1. [x, y, z]\n",
        "['a', 'b', 'c']", "[['a', 'b',  'c'], ['d',  'e', 'f']]", "Subject: a, Predicate: b, Object: c\nx",
        "Subject: a\n\nPredicate: b\n\nObject: c", "12. dashless line\nnext", "v 1.2 - x. y - z", "3. q\n", "Subject: a, Predicate: b\n(c, d, e)",
    ]
    rows = [(i, f"source {i}", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").createOrReplaceTempView("documents")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "source", "text"]))
    names = ["run", "reader", "status", "documents", "items"]
    got = sorted(tuple(r) for r in extraction.read_documents(spark).select(*names).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({extraction._cascade_sql()})").fetchall())
    assert len({r[1] for r in got}) >= 9
