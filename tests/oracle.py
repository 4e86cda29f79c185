"""Compares a Spark result with DuckDB's, rows unordered."""

import datetime
import decimal
import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def canon(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (float, np.floating)):
        return None if x != x else float(f"{x:.9g}") + 0.0
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (datetime.date, pd.Timestamp)):
        return str(pd.Timestamp(x))
    if isinstance(x, (list, np.ndarray)):
        return tuple(canon(y) for y in x)
    return x


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(canon(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def assert_same(spark_df, con, sql: str) -> None:
    a, b = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    assert rows(a) == rows(b)
