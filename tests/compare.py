"""Run queries and their SQL side by side: python tests/compare.py [names...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from wayside.session import build_session  # noqa: E402

SF = os.environ.get("CHECK_SF", "/root/testdata/sf0.01")


def connect(sf: str = SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canon(value):
    """A comparable form: equal numbers, lists and structs print alike."""
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return "[" + ",".join(canon(v) for v in value) + "]"
    if hasattr(value, "asDict"):
        return canon(value.asDict())
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canon(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def check(spark, con, name, sf: str = SF):
    """Return (ok, message) for one query."""
    started = time.time()
    df = entry.queries()[name](spark, sf)
    got = df.collect()
    took = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"rows-only {len(got)} rows, spark {took:.1f}s"
    started = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - started
    note = f"spark {took:.1f}s sql {sql_took:.1f}s rows {len(got)}/{len(want)}"
    if sorted(cols) != sorted(df.columns):
        return False, f"columns differ: {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a = [x for x in a if x not in in_b][:3]
        only_b = [x for x in b if x not in in_a][:3]
        return False, f"{note}\n   columns {sorted(cols)}\n   spark {only_a}\n   sql   {only_b}"
    return True, note if got else note + " EMPTY"


def main(names):
    spark, con = build_session("compare"), connect()
    bad = 0
    for name in names or entry.queries():
        try:
            ok, note = check(spark, con, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
