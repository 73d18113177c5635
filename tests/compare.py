"""Run registered queries next to their SQL in DuckDB.

    python -m tests.compare [--sf 0.01] [query ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import glob
import os
import time

import duckdb

DATA = "/root/testdata"


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in glob.glob(f"{path}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return con


def _value(v: object) -> tuple[str, str]:
    if v is None:
        return ("", "")
    if isinstance(v, bool):
        return ("bool", str(v))
    if isinstance(v, int):
        return ("int", str(v))
    if isinstance(v, float):
        return ("float", repr(v + 0.0))
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return ("time", v.isoformat())
    return (type(v).__name__, str(v))


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return df.columns, rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return columns, rows_of(columns, cur.fetchall())


def difference(spark_side, sql_side) -> str | None:
    (a_cols, a), (b_cols, b) = spark_side, sql_side
    if sorted(a_cols) != sorted(b_cols):
        return f"columns {sorted(a_cols)} against {sorted(b_cols)}"
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}; e.g. {sorted(set(a) ^ set(b))[:3]}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, columns {sorted(a_cols)}, e.g. {bad[0]}"
    return None


def main() -> None:
    from driftline.session import build_session
    from driftline.workload import ORACLES, QUERIES

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    path = f"{DATA}/sf{args.sf}"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    con = connect(path)
    bad = []
    for name, run in QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            got = spark_rows(run(spark, path))
            took = time.time() - start
            problem = difference(got, sql_rows(con, ORACLES[name])) if name in ORACLES else None
            text = problem or ("ok" if name in ORACLES else "rows only")
            print(f"{name:34} {took:6.2f}s {len(got[1]):7} rows  {text}"[:900], flush=True)
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {e}"
            print(f"{name:34} FAILED {problem[:900]}", flush=True)
        if problem:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
