"""Compare a query with its SQL in DuckDB, order aside."""

import os

import duckdb
import pandas as pd


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


def canon(df):
    def v(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "-"
        if hasattr(x, "item"):
            return v(x.item())
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else f"{x:.6g}"
        return str(x)

    return sorted(tuple(v(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark, folder, query, sql, conn):
    got, want = query(spark, folder).toPandas(), conn.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
