"""Run catalogue queries in Spark and their SQL in DuckDB, and compare the sorted rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from foliospark.plans.fixtures import TABLES


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return "0.0" if value == 0 else repr(round(value, 9))
    if isinstance(value, decimal.Decimal):
        return repr(round(float(value), 9))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return str([normal(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    """None when both agree, else a short reason; also the number of rows and the two times."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return None, len(got), t1 - t0, 0.0
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got), t1 - t0, t2 - t1
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return None, len(got), t1 - t0, t2 - t1
    in_a, in_b = set(a), set(b)
    only_a = [r for r in a if r not in in_b][:2]
    only_b = [r for r in b if r not in in_a][:2]
    return f"rows {len(a)} vs {len(b)}; spark {only_a} duck {only_b}", len(got), t1 - t0, t2 - t1


def main() -> int:
    from pyspark.sql import SparkSession

    from foliospark.plans.catalog import ORACLES, QUERIES

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            why, n, ts, td = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            why, n, ts, td = f"{type(exc).__name__}: {str(exc)[:500]}", -1, 0, 0
        bad += why is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'ok ' if why is None else 'BAD'} {name:24s} {kind} n={n} spark={ts:.1f}s duck={td:.2f}s {why or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
