"""Run registered queries in Spark and their oracle SQL in DuckDB; compare results.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Prints one line per query: status, spark rows, oracle rows, seconds.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from clickpath.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    rows = df.collect()
    t1 = time.time()
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    s_rows = sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)
    if sql is None:
        return dict(name=name, status="rows-only", spark_rows=len(rows), secs=round(t1 - t0, 2))
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    if sorted(ocols) != sorted(cols):
        return dict(name=name, status="SCHEMA", spark=cols, oracle=ocols)
    oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
    o_rows = sorted((tuple(norm(r[i]) for i in oorder) for r in orows), key=repr)
    ok = s_rows == o_rows
    out = dict(name=name, status="OK" if ok else "MISMATCH", spark_rows=len(rows),
               oracle_rows=len(orows), secs=round(t1 - t0, 2))
    if not ok:
        sd = [r for r in s_rows if r not in set(o_rows)][:3]
        od = [r for r in o_rows if r not in set(s_rows)][:3]
        out.update(spark_only=repr(sd)[:600], oracle_only=repr(od)[:600])
    return out


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from clickpath.plans import ORACLE, QUERIES
    from clickpath.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, ORACLE.get(name), sf_dir)
        except Exception as e:  # report and continue
            r = dict(name=name, status="ERROR", error=str(e)[:800])
        bad += r["status"] not in ("OK", "rows-only")
        print(json.dumps(r, default=str), flush=True)
    print(json.dumps({"failed": bad}))


if __name__ == "__main__":
    main()
