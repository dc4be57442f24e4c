"""Runs queries and their check SQL side by side: python tests/check_oracle.py [folder] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, run, sql):
    t0 = time.time()
    df = run(spark, folder)
    got = df.collect()
    t1 = time.time()
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    t2 = time.time()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", t1 - t0, t2 - t1, len(got)
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        return f"{len(got)} vs {len(want)} rows; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}", t1 - t0, t2 - t1, len(got)
    return None, t1 - t0, t2 - t1, len(got)


def main(folder="/root/testdata/sf0.01", *names):
    from shelfrank.session import build_session

    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("OFF")
    con, checks, bad = connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if names and not any(n in name for n in names):
            continue
        if name not in checks:
            print(f"-- {name}: no check", flush=True)
            continue
        try:
            problem, a, b, n = compare(spark, con, folder, name, run, checks[name])
        except Exception as e:  # noqa: BLE001
            problem, a, b, n = f"{type(e).__name__}: {str(e)[:600]}", 0, 0, 0
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} n={n} spark={a:.1f}s duck={b:.1f}s {problem or ''}"[:900], flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
