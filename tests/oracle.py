"""Compare registered queries with their SQL on the given tables.

Usage: python tests/oracle.py FOLDER [NAME PREFIX ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return f"{value:.6f}" if value != int(value) or abs(value) > 1e15 else f"{value:.6f}"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def frame_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None if equal, else what differs."""
    rel = con.sql(sql)
    want_names, want = frame_rows(rel.columns, rel.fetchall())
    got_names, got = frame_rows(df.columns, [tuple(r) for r in df.collect()])
    if want_names != got_names:
        return f"columns {got_names} instead of {want_names}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [(n, k, types[n]) for n, k in df.dtypes if kinds.get(k, k) != types[n]]
    if len(want) != len(got):
        return f"{len(got)} rows instead of {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"[:900]
    return f"types differ: {odd}" if odd else None


def main() -> int:
    folder, wanted = sys.argv[1], sys.argv[2:]
    from lumenpair.plans import catalog
    from lumenpair.session import build_session

    spark = build_session(
        master="local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="8g",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, build in catalog.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            sql = catalog.ORACLES.get(name)
            if sql is None:
                verdict = None if (n := len(df.collect())) else "no rows"
                note = f"rows only: {n}"
            else:
                verdict, note = compare(df, con, sql), ""
        except Exception as exc:
            verdict, note = f"{type(exc).__name__}: {str(exc)[:1500]}", ""
        failed += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {time.time() - start:.1f}s {verdict or note}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
