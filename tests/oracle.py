"""Runs the registered queries next to their SQL in DuckDB and compares the results.

    python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(v + 0.0)
    if v is None:
        return "null"
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, run, sql: str | None) -> tuple[bool, str]:
    df = run(spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got[1]) > 0, f"{len(got[1])} rows, no SQL"
    result = con.execute(sql)
    want = canonical([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return True, f"{len(got[1])} rows"
    mine, theirs = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    return False, (f"{len(got[1])} rows != {len(want[1])}; differing {len(mine)}/{len(theirs)}; "
                   f"got {sorted(mine)[:3]} want {sorted(theirs)[:3]}")


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            ok, what = compare(spark, con, sf, queries[name], oracle.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, what = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - start:6.1f}s {what}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
