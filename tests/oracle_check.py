"""Run registered queries on Spark and their oracle SQL on DuckDB; compare results.

    python tests/oracle_check.py [sf_dir] [name ...]

Comparison: same column names, same row count, and the same multiset of rows after
rounding floats to 6 places (column order ignored).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    import datetime
    import decimal

    import numpy as np

    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT:
        return "<null>"
    if isinstance(v, float) and math.isnan(v):
        return "<null>"
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        x = round(float(v), 6)
        if x == int(x) and abs(x) < 2**53:
            return str(int(x))
        return repr(x)
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def rows_of(df_pandas):
    cols = sorted(df_pandas.columns)
    out = []
    for rec in df_pandas[cols].itertuples(index=False):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    sp = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return {"name": name, "status": "rows-only", "rows": len(sp), "spark_s": round(t1 - t0, 2)}
    dp = con.execute(sql).fetchdf()
    t2 = time.time()
    sc, sr = rows_of(sp)
    dc, dr = rows_of(dp)
    res = {"name": name, "rows": len(sp), "oracle_rows": len(dp), "spark_s": round(t1 - t0, 2),
           "duck_s": round(t2 - t1, 2)}
    if sc != dc:
        res.update(status="COLUMNS", spark_cols=sc, duck_cols=dc)
    elif sr != dr:
        ds_, ss_ = set(dr), set(sr)
        only_s = [r for r in sr if r not in ds_][:3]
        only_d = [r for r in dr if r not in ss_][:3]
        res.update(status="VALUES", cols=sc, only_spark=only_s, only_duck=only_d)
    else:
        res.update(status="ok")
    return res


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from reelspark.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    oracles = oracle_sql()
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        try:
            res = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:  # report and continue
            res = {"name": name, "status": "ERROR", "error": f"{type(e).__name__}: {str(e)[:600]}"}
        if res["status"] not in ("ok", "rows-only"):
            bad += 1
        print(res, flush=True)
    print(f"== {bad} problem(s)")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
