"""Compare registered queries with their DuckDB twins: ``python tests/oracle_check.py SF_DIR [NAME...]``."""

from __future__ import annotations

import math
import os
import sys

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows_of(frame) -> list:
    def plain(x):
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return None if x is pd.NA else x

    columns = sorted(frame.columns)
    return sorted((tuple(plain(x) for x in r) for r in frame[columns].itertuples(index=False, name=None)), key=lambda r: [(x is None, str(x)) for x in r])


def connection(sf_dir: str):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            c.execute(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    return c


def compare(spark, sf_dir: str, name: str, query, sql: str) -> str:
    """An empty string if both give the same rows, else what differs."""
    got, want = query(spark, sf_dir).toPandas(), connection(sf_dir).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    odd = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(odd)} of {len(a)} rows differ: {odd[:2]}" if odd else ""


if __name__ == "__main__":
    from tallyloom import queries as Q
    from tallyloom.session import session

    spark = session(master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[2:] or list(Q.oracle_sql())
    for n in names:
        try:
            said = compare(spark, sys.argv[1], n, Q.queries()[n], Q.oracle_sql()[n])
        except Exception as e:  # noqa: BLE001  a report, not a handler
            said = f"failed: {str(e)[:700]}"
        if said:
            print(n, said)
    print("compared", len(names))
