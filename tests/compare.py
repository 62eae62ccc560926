"""Runs queries against their SQL: python tests/compare.py SF NAME... (or a prefix with *)."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) if abs(v) < 1e6 else float(f"{v:.10g}")
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if type(v).__name__ == "Decimal":
        return float(v) if v != int(v) else int(v)
    if type(v).__name__ in ("datetime", "date"):
        return str(v)
    return v


def duck(sf: str):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    return c


def rows_of(cols: list[str], rows) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name: str, sf: str, con=None) -> str:
    import __spark_entry__ as e

    q, sql = e.queries()[name], e.oracle_sql().get(name)
    t = time.time()
    df = q(spark, sf)
    got = rows_of(df.columns, df.collect())
    took = time.time() - t
    if sql is None:
        return f"rows {len(got)} {took:.1f}s"
    t = time.time()
    cur = (con or duck(sf)).execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(cols)}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"DIFF {len(got)} rows, {len(want)} wanted; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"
    return f"same {len(got)} rows {took:.1f}s, sql {time.time() - t:.1f}s"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    import logging

    logging.disable(logging.CRITICAL)
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf = sys.argv[1]
    con = duck(sf)
    for n in e.queries():
        if any(n == a or a.endswith("*") and n.startswith(a[:-1]) for a in sys.argv[2:]):
            try:
                print(n, compare(spark, n, sf, con), flush=True)
            except Exception as x:
                print(n, "ERROR", str(x)[:400], flush=True)
