"""Run a query in Spark and its SQL in DuckDB and compare the rows.

Also a command: ``python -m tests.oracle [sf_dir] [name part ...]``.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from tidemark.queries import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "as_integer_ratio"):
        return float(v) if not isinstance(v, int) else v
    return str(v)


def sort_key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, bool) else int(v)) if v is not None else (True, "", 0) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: str(r))


def compare(spark, con, sf_dir: str, name: str):
    """None if equal, else a short text; the number of rows is returned as well."""
    df = QUERIES[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return (None if got else "no rows"), len(got)
    cur = con.execute(ORACLES[name])
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; {got[:2]} / {want[:2]}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return (f"{len(bad)} rows differ, first {bad[0]}" if bad else None), len(got)


def main(argv):
    from tidemark.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name in QUERIES:
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", 0
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} {n:7d} rows {time.time() - start:6.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
