"""Compare named queries with their SQL oracle in DuckDB.

Usage: python -m tests.oracle [-s SCALE] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


LAST_ROWS = [0]


def folder(scale: str) -> str:
    return f"/root/testdata/sf{scale}"


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else (value + 0.0 if value else 0.0)
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], [tuple(plain(r[i]) for i in order) for r in rows]


def compare(spark_df, con, sql) -> list[str]:
    names, got = rows_of(spark_df.columns, spark_df.collect())
    cursor = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    LAST_ROWS[0] = len(got)
    problems = []
    if names != want_names:
        return [f"columns differ: {names} vs {want_names}"]
    if len(got) != len(want):
        problems.append(f"row counts differ: {len(got)} vs {len(want)}")
    for i, name in enumerate(names):
        kinds = {kind(r[i]) for r in got if r[i] is not None}, {kind(r[i]) for r in want if r[i] is not None}
        if kinds[0] and kinds[1] and kinds[0] != kinds[1]:
            problems.append(f"column {name} types differ: {kinds[0]} vs {kinds[1]}")
    only_got, only_want = Counter(got) - Counter(want), Counter(want) - Counter(got)
    if only_got or only_want:
        problems.append(f"{sum(only_got.values())} rows only in Spark, {sum(only_want.values())} only in SQL")
        key = lambda r: tuple((x is None, str(x)) for x in r)
        for tag, rows in (("spark", only_got), ("sql  ", only_want)):
            for row in sorted(rows, key=key)[:4]:
                problems.append(f"  {tag} {dict(zip(names, row))}")
    return problems


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tallygrid.plans.catalogue import queries as registered
    from tallygrid.plans.registry import subject_of
    from tallygrid.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("-s", "--scale", default="0.01")
    parser.add_argument("-m", "--module", action="append")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("oracle")
    queries, oracles = entry.queries(), entry.oracle_sql()
    if args.module:
        names = [n for n in registered() if subject_of(n) in args.module]
    else:
        names = args.names or list(queries)
    con = connect(folder(args.scale))
    failed = 0
    for name in names:
        start = time.time()
        try:
            frame = queries[name](spark, folder(args.scale))
            if name in oracles:
                problems = compare(frame, con, oracles[name])
                note = f"ok {LAST_ROWS[0]} rows"
            else:
                problems, note = [], f"rows only: {frame.count()}"
        except Exception as error:  # noqa: BLE001 - report every failure
            problems, note = [f"{type(error).__name__}: {str(error)[:700]}"], ""
        took = time.time() - start
        print(f"{'FAIL' if problems else 'pass'} {name} {took:.2f}s {note if not problems else ''}", flush=True)
        for p in problems:
            print("     ", p)
        failed += bool(problems)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
