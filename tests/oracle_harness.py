"""Run a Spark query and its DuckDB oracle on the same parquet tables and compare.

Usage: python tests/oracle_harness.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(pdf: pd.DataFrame) -> list:
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, name: str, fn, sql: str, sf_dir: str, con=None) -> dict:
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    odf = con.execute(sql).df()
    t2 = time.time()
    res = {"query": name, "spark_rows": len(sdf), "oracle_rows": len(odf),
           "spark_s": round(t1 - t0, 2), "oracle_s": round(t2 - t1, 2)}
    res["columns_match"] = sorted(sdf.columns) == sorted(odf.columns)
    if not res["columns_match"]:
        res["spark_cols"], res["oracle_cols"] = sorted(sdf.columns), sorted(odf.columns)
        res["match"] = False
        return res
    a, b = rows_of(sdf), rows_of(odf)
    res["match"] = a == b
    if not res["match"]:
        sa, sb = set(a), set(b)
        res["only_spark"] = [r for r in a if r not in sb][:3]
        res["only_oracle"] = [r for r in b if r not in sa][:3]
    return res


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from headline_engine.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session(8)
    qs, sqls = queries(), oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            print({"query": name, "rows_only": df.count()}, flush=True)
            continue
        r = compare(spark, name, qs[name], sqls[name], sf_dir, con)
        bad += not r["match"]
        print(r, flush=True)
    print("mismatches:", bad)


if __name__ == "__main__":
    main(sys.argv)
