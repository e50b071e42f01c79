"""Run registered queries beside their SQL and report differences.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

from checks.oracles import oracle_sql
from checks.queries import queries
from checks.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return v


def rows_of(names, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark, con, sf_dir: str, name: str) -> tuple[int, str]:
    """(rows, "") if the two results are equal, else what differs."""
    df = queries()[name](spark, sf_dir)
    got_names, got = rows_of(df.columns, df.collect())
    total = sum(got.values())
    if name not in oracle_sql():
        return total, ""
    cur = con.execute(oracle_sql()[name])
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return total, f"columns {got_names} != {want_names}"
    if got != want:
        return total, (
            f"{total} vs {sum(want.values())} rows\n   only spark {list((got - want).items())[:3]}"
            f"\n   only sql   {list((want - got).items())[:3]}"
        )
    return total, ""


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(queries())
    spark, con, bad = local_session("compare"), connect(sf_dir), 0
    for name in names:
        began = time.time()
        try:
            total, problem = difference(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            total, problem = -1, f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        how = "" if name in oracle_sql() else " (rows only)"
        print(f"{'BAD ' if problem else 'ok  '} {name:36s} {total:8d} rows {time.time() - began:6.2f}s{how} {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
