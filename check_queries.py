"""Run registered queries and compare each with its SQL in DuckDB.

    python check_queries.py [--sf /root/testdata/sf0.01] [--module metrics] [name ...]
"""

from __future__ import annotations

import argparse
import importlib
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def bag(names, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def sql_bag(con, sql: str):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    return bag(names, result.fetchall())


def compare(left, right) -> str | None:
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] == right[1]:
        return None
    a, b = left[1] - right[1], right[1] - left[1]
    return (
        f"{sum(left[1].values())} vs {sum(right[1].values())} rows; {sum(a.values())} differ, "
        f"e.g. spark {next(iter(a), None)} sql {next(iter(b), None)}"
    )


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--module")
    args = parser.parse_args()
    if args.module:
        module = importlib.import_module(f"registry.{args.module}")
        queries, oracles = module.QUERIES, module.ORACLES
    else:
        from registry import ORACLES as oracles
        from registry import QUERIES as queries
    from diffspark.session import local_session

    spark = local_session(8)
    con = duck(args.sf)
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, args.sf)
            got = bag(df.columns, [tuple(r) for r in df.collect()])
            seconds = time.time() - start
            if name not in oracles:
                print(f"ROWS  {name:32s} {seconds:6.2f}s {sum(got[1].values())} rows", flush=True)
                continue
            problem = compare(got, sql_bag(con, oracles[name]))
        except Exception as error:  # noqa: BLE001
            seconds, problem = time.time() - start, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        rows = "" if problem else sum(got[1].values())
        print(f"{'FAIL' if problem else 'OK  '}  {name:32s} {seconds:6.2f}s {problem or ''} {rows}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
