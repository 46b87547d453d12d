"""Run registered queries on Spark and their SQL on DuckDB and compare whole results.

``python tests/compare.py [--sf DIR] [name ...]`` prints one line per query.
"""

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or v is pd.NaT:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not hasattr(v, "isoformat"):
        v = v.tolist() if hasattr(v, "tolist") else v
        return "[" + ",".join(map(_cell, v)) + "]" if isinstance(v, (list, tuple)) else _cell(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(_cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return rows_of(cols, cur.fetchall())


def difference(got, want):
    """None when equal, else a short description."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return (f"rows {len(got[1])} vs {len(want[1])}; only spark {sorted(a - b)[:2]}; "
                f"only sql {sorted(b - a)[:2]}")
    return None


def local_session():
    from logweave.session import build_session
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i:i + 2]
    from logweave.plans import load_queries
    queries, sqls = load_queries()
    names = [n for n in queries if not argv or n in argv or any(a.endswith("*") and n.startswith(a[:-1]) for a in argv)]
    spark, con, bad = local_session(), duck(sf), 0
    for name in names:
        t = time.time()
        try:
            got = spark_rows(queries[name](spark, sf))
            spent = time.time() - t
            if name not in sqls:
                print(f"rows  {name} {len(got[1])} {spent:.1f}s", flush=True)
                continue
            t = time.time()
            want = duck_rows(con, sqls[name])
            diff = difference(got, want)
            bad += diff is not None
            print(f"{'ok   ' if diff is None else 'DIFF '} {name} {len(got[1])} {spent:.1f}s sql {time.time() - t:.1f}s {diff or ''}", flush=True)
        except Exception as e:
            bad += 1
            print(f"FAIL  {name} {type(e).__name__} {str(e)[:600]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
