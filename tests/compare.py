"""Run queries on Spark and their SQL on DuckDB, and compare columns and rows.

    python -m tests.compare [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def kinds(columns, types):
    return {c: t for c, t in zip(columns, types)}


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE",
}


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols, s_bag = bag(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if sql is None:
        return True, f"{sum(s_bag.values())} rows, no SQL", took
    cur = con.execute(sql)
    d_names = [c[0] for c in cur.description]
    d_types = {c[0]: str(c[1]) for c in cur.description}
    d_cols, d_bag = bag(d_names, cur.fetchall())
    problems = []
    if s_cols != d_cols:
        problems.append(f"columns {s_cols} != {d_cols}")
    else:
        for f, t in df.dtypes:
            if SAME_TYPE.get(t, t) != d_types[f]:
                problems.append(f"type of {f}: {t} != {d_types[f]}")
    if s_bag != d_bag:
        only_s, only_d = list((s_bag - d_bag).items()), list((d_bag - s_bag).items())
        problems.append(f"rows {sum(s_bag.values())}/{sum(d_bag.values())}, {len(only_s)} differ: "
                        f"spark {sorted(map(str, only_s))[:2]} duck {sorted(map(str, only_d))[:2]}")
    return not problems, "; ".join(problems) or f"{sum(s_bag.values())} rows", took


def main() -> int:
    from pyspark.sql import SparkSession

    from fieldcheck.queries import ORACLES, QUERIES

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.001"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name, fn in QUERIES.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            ok, text, took = compare(spark, con, sf_dir, name, fn, ORACLES.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, text, took = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.2f}s {text[:1200]}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
