"""Run registered queries against their DuckDB oracles: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(got[1])} rows, no oracle"
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got == want:
        return True, f"{len(got[1])} rows"
    if got[0] != want[0]:
        return False, f"columns {got[0]} vs {want[0]}"
    a, b = set(got[1]), set(want[1])
    return False, (f"rows {len(got[1])} vs {len(want[1])}\n   spark only {sorted(a - b)[:3]}\n   duck only  {sorted(b - a)[:3]}")


if __name__ == "__main__":
    import __spark_entry__ as entry
    from questlog.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/sf{sf}"
    con = duck(sf_dir)
    oracle = entry.oracle_sql()
    bad = []
    for name, q in entry.queries().items():
        if sys.argv[2:] and not any(a in name for a in sys.argv[2:]):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name, q, oracle.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        if not ok:
            bad.append(name)
        print("ok  " if ok else "FAIL", name, f"{time.time() - t:.1f}s", note, flush=True)
    print(len(bad), "failed:", bad)
