"""Runs registered queries against their SQL and reports row, schema and value matches."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from gridmere.catalog.registry import TABLES


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def oracle(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    """Returns (ok, rows, seconds, message)."""
    t = time.time()
    df = fn(spark, sf_dir)
    names, rows = df.columns, [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return True, len(rows), took, "rows only"
    res = con.execute(sql)
    want_names = [d[0] for d in res.description]
    want = res.fetchall()
    got, exp = table_of(names, rows), table_of(want_names, want)
    if got[0] != exp[0]:
        return False, len(rows), took, f"columns {got[0]} != {exp[0]}"
    if len(got[1]) != len(exp[1]):
        return False, len(rows), took, f"rows {len(got[1])} != {len(exp[1])}"
    bad = [(g, e) for g, e in zip(got[1], exp[1]) if g != e]
    if bad:
        return False, len(rows), took, f"{len(bad)} rows differ, first: {bad[0]}"
    kinds = {type(x) for r in got[1] for x in r} ^ {type(x) for r in exp[1] for x in r}
    return True, len(rows), took, "match" + (f" (types {kinds})" if kinds else "")


if __name__ == "__main__":
    from gridmere.catalog import ORACLES, QUERIES
    from gridmere.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf)
    failed = []
    for n in wanted:
        try:
            ok, rows, took, msg = compare(spark, con, sf, n, QUERIES[n], ORACLES.get(n))
        except Exception as e:  # report and go on
            ok, rows, took, msg = False, 0, 0.0, f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {n:34s} {rows:8d} {took:6.2f}s {msg[:900]}", flush=True)
        if not ok:
            failed.append(n)
    print(f"{len(wanted) - len(failed)}/{len(wanted)} ok; failed: {failed}")
