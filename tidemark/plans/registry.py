"""The registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``, with its SQL where there is one."""
    def add(f: QueryFn) -> QueryFn:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show; -0.0 becomes 0.0."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(*names: str, digits: int = 6) -> str:
    """SQL: the same rounding."""
    return ", ".join(f"round({n}, {digits}) + 0.0::DOUBLE AS {n.split('.')[-1]}" for n in names)
