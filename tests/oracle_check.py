"""Runs named queries and their SQL on one directory and compares the results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from landq.plans.catalogue import CATALOGUE
from landq.plans.fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else format(v, ".12g")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str):
    """(ok, message, rows, seconds)."""
    entry = CATALOGUE[name]
    start = time.time()
    df = entry.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if entry.sql is None:
        return True, "rows only", len(got), took
    cur = con.execute(entry.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {df.columns} != {names}", len(got), took
    a, b = canonical(df.columns, got), canonical(names, want)
    if a != b:
        sa, sb = set(a), set(b)
        only_a, only_b = [x for x in a if x not in sb][:3], [x for x in b if x not in sa][:3]
        return False, f"{len(a)} vs {len(b)} rows {sorted(df.columns)}\n   spark {only_a}\n   duck  {only_b}", len(got), took
    return True, "equal", len(got), took


if __name__ == "__main__":
    from landq.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    con = connect(sf)
    names = [n for n in CATALOGUE if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    bad = 0
    for n in names:
        try:
            ok, msg, rows, took = compare(spark, con, sf, n)
        except Exception as e:  # noqa: BLE001
            ok, msg, rows, took = False, f"{type(e).__name__}: {str(e)[:1500]}", -1, 0
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {n} rows={rows} {took:.2f}s {msg}", flush=True)
    print("bad:", bad, "of", len(names))
