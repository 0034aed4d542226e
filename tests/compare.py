"""Compare registered queries with their SQL: ``python tests/compare.py SF_DIR [NAME...]``."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spark_session(cpus: str = "8"):
    from pyspark.sql import SparkSession
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("zephyrgrid-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(value)
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    try:
        return float(value) if type(value).__name__ == "Decimal" else str(value)
    except (TypeError, ValueError):
        return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr), [columns[i] for i in order]


def compare(spark, con, name, run, oracle, folder):
    """None when both sides agree, else what differs."""
    df = run(spark, folder)
    got, cols = rows_of(df.columns, df.collect())
    if oracle is None:
        return None if got else "no rows", len(got)
    cur = con.execute(oracle)
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}", len(got)
    if got == want:
        return (None if got else "no rows on both sides"), len(got)
    only_got, only_want = sorted(set(got) - set(want), key=repr), sorted(set(want) - set(got), key=repr)
    return (f"rows {len(got)} / {len(want)}, differing {len(only_got)} / {len(only_want)}\n    {cols}\n"
            f"    spark {only_got[:3]}\n    sql   {only_want[:3]}"), len(got)


def main(argv):
    import __spark_entry__ as e
    folder, names = argv[0], argv[1:]
    spark, con = spark_session(), duck(argv[0])
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = e.queries(), e.oracle_sql()
    bad = []
    for name in names or queries:
        start = time.time()
        try:
            problem, n = compare(spark, con, name, queries[name], oracles.get(name), folder)
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", 0
        spent = time.time() - start
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {name:26s} {kind:4s} {n:7d} rows {spent:6.2f}s"
              + (f"\n  {problem}" if problem else ""), flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} bad: {' '.join(bad)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
