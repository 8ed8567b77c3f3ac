"""Runs registered queries against their SQL: ``python -m tests.compare [sf] [name part …]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str:
    """Empty when equal, else what differs."""
    got = rows_of(spark_df.columns, spark_df.collect())
    rel = con.execute(sql)
    columns = [c[0] for c in rel.description]
    want = rows_of(columns, rel.fetchall())
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}"
    return "" if got else "no rows"


def main(argv: list[str]) -> int:
    from tests.session import make_session

    import __spark_entry__ as contract

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, oracle, failed = make_session(), connect(sf_dir), contract.oracle_sql(), 0
    for name, fun in contract.queries().items():
        if argv[1:] and not any(part in name for part in argv[1:]):
            continue
        began = time.time()
        try:
            df = fun(spark, sf_dir)
            if name in oracle:
                problem = compare(df, con, oracle[name])
            else:
                n = df.count()
                problem = "" if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - began:.1f}s {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
