"""Run registered queries and compare each with its SQL in DuckDB.

    python tests/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

import duckdb

import __spark_entry__ as entry
from gistworks.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def shaped(columns, rows):
    """Rows with columns in name order, sorted as text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, int, float, float]:
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    columns = df.columns
    ours = [tuple(r) for r in df.collect()]
    spark_time = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows-only", len(ours), spark_time, 0.0
    start = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    sql_time = time.time() - start
    if sorted(names) != sorted(columns):
        return f"COLUMNS {sorted(columns)} {sorted(names)}", len(ours), spark_time, sql_time
    a, b = shaped(columns, ours), shaped(names, theirs)
    if a == b:
        return "ok", len(ours), spark_time, sql_time
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    detail = f"DIFF rows {len(a)}/{len(b)}, differing {len(only_a)}/{len(only_b)}"
    for side in (only_a, only_b):
        for line in side[:2]:
            detail += "\n      " + line[:700]
    return detail, len(ours), spark_time, sql_time


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--show", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = local_session(), database(args.sf)
    failed = 0
    for name in args.names or entry.queries():
        try:
            verdict, rows, t1, t2 = compare(spark, con, args.sf, name)
        except Exception as error:  # noqa: BLE001
            verdict, rows, t1, t2 = "ERROR " + str(error)[:1500], 0, 0, 0
        if args.show:
            entry.queries()[name](spark, args.sf).show(5, 150)
        failed += verdict not in ("ok", "rows-only")
        print(f"{name:28s} rows={rows:7d} spark={t1:6.2f}s sql={t2:6.2f}s {verdict}", flush=True)
    print("failed:", failed)
