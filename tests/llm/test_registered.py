"""Registered queries: names, and rows against SQL where there is some."""

import pytest

from compare import compare, duck
from tripleframe.llm.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0]) if q.startswith("op") else 99) == [*(q for n in range(1, 14) for q in QUERIES if q.startswith(f"op{n}_")), "pipeline"]
    assert len(QUERIES) == 14


@pytest.mark.parametrize("name", SQL)
def test_rows_are_those_of_the_sql(spark, name):
    ok, message, _ = compare(spark, duck(SF), name, QUERIES[name], SQL[name], SF)
    assert ok, message
