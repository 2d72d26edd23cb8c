"""Spark-vs-DuckDB comparison in the way the driver does it.

Row count, column names, and an order-insensitive hash of the values (columns
sorted by name, doubles rounded to 6 places) must all agree.

CLI: ``python tests/oracle_harness.py [sf_dir] [query ...]``.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codecorpus.plans.fixtures import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def digest(cols: list[str], rows: list[tuple]) -> tuple[int, str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    hs = sorted(hashlib.md5(repr(tuple(_norm(r[i]) for i in order)).encode()).hexdigest()
                for r in rows)
    return len(rows), hashlib.md5("".join(hs).encode()).hexdigest()


def spark_rows(df):
    cols = df.columns
    return cols, [tuple(r) for r in df.collect()]


def compare(spark, con, name: str, sf_dir: str, query, sql: str | None):
    t0 = time.time()
    df = query(spark, sf_dir)
    scols, srows = spark_rows(df)
    t1 = time.time()
    out = {"query": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["check"] = "rows-only"
        return out
    rel = con.sql(sql)
    dcols = list(rel.columns)
    drows = rel.fetchall()
    out["duck_rows"] = len(drows)
    out["schema_match"] = sorted(scols) == sorted(dcols)
    if not out["schema_match"]:
        out["spark_cols"], out["duck_cols"] = scols, dcols
    out["match"] = out["schema_match"] and digest(scols, srows) == digest(dcols, drows)
    if not out["match"] and out["schema_match"]:
        order_s = sorted(range(len(scols)), key=lambda i: scols[i])
        order_d = sorted(range(len(dcols)), key=lambda i: dcols[i])
        ss = {tuple(_norm(r[i]) for i in order_s) for r in srows}
        dd = {tuple(_norm(r[i]) for i in order_d) for r in drows}
        out["only_spark"] = [repr(x)[:400] for x in list(ss - dd)[:2]]
        out["only_duck"] = [repr(x)[:400] for x in list(dd - ss)[:2]]
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from codecorpus.session import get_spark
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        try:
            r = compare(spark, con, name, sf_dir, qs[name], sqls.get(name))
        except Exception as e:  # report and continue
            r = {"query": name, "error": repr(e)[:1500]}
        if not r.get("match", r.get("check") == "rows-only"):
            bad += 1
        print(r, flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv)
