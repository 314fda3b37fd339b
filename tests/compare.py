"""Run registered queries in Spark and their SQL in DuckDB on the same tables and compare all rows.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import threading
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tripleframe.plans.views import TABLES  # noqa: E402


LIMIT = 40  # seconds a statement or a query may take


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """(ok, message, seconds) of one query."""
    start = time.time()
    df = query(spark, sf_dir)
    stop = threading.Timer(LIMIT, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        rows = [tuple(r) for r in df.collect()]
    finally:
        stop.cancel()
    took = time.time() - start
    if sql is None:
        return True, f"{len(rows)} rows, no SQL", took
    alarm = threading.Timer(LIMIT, con.interrupt)
    alarm.start()
    try:
        cursor = con.execute(sql)
        names, expected = [d[0] for d in cursor.description], cursor.fetchall()
    finally:
        alarm.cancel()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", took
    mine, theirs = bag(df.columns, rows), bag(names, expected)
    if mine == theirs:
        return True, f"{len(rows)} rows", took
    extra, missing = list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
    return False, f"{len(rows)} vs {len(expected)} rows; only Spark {extra}; only SQL {missing}", took


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from tripleframe.session import local_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(), duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        try:
            ok, message, took = compare(spark, con, name, queries[name], sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, message, took = False, f"{type(error).__name__}: {str(error)[:900]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {took:6.2f}s  {message}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
