"""Compare registered queries with their SQL in DuckDB: python -m tests.oracle_check [names…]"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def kinds_of(names, rows):
    """Column → Python types of its values, before any conversion."""
    return {n: {type(r[i]).__name__ for r in rows if r[i] is not None} for i, n in enumerate(names)}


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    raw = [tuple(r) for r in df.collect()]
    got = rows_of(df.columns, raw)
    spent = time.time() - start
    if sql is None:
        return f"ROWS {len(got)}", spent, None
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    other = cur.fetchall()
    want = rows_of(names, other)
    took = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}", spent, took
    if got == want:
        a, b = kinds_of(df.columns, raw), kinds_of(names, other)
        odd = {n: (a[n], b[n]) for n in a if a[n] != b[n]}
        if odd:
            return f"TYPES {odd}", spent, took
        return (f"ok {len(got)}" if got else "EMPTY"), spent, took
    diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
    return f"DIFF {len(got)} vs {len(want)}: {diff}", spent, took


def session():
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master("local[8]").appName("oracle-check")
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
            .getOrCreate())


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    picked = [n for n in queries if not argv or any(n == a or n.startswith(a) for a in argv)]
    bad = []
    for name in picked:
        try:
            verdict, spent, took = compare(spark, con, sf_dir, name, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict, spent, took = f"ERROR {type(error).__name__}: {str(error)[:1500]}", 0, 0
        if not verdict.startswith(("ok", "ROWS")):
            bad.append(name)
        print(f"{name:45s} {spent:6.2f}s {took or 0:6.2f}s  {verdict[:1600]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
