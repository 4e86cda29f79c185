"""Reproducible price paths for trials without data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the sha256 of the parts: the same on every machine and in any order of rows."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("double") / 2.0**32


def price_paths(spark: SparkSession, assets: int, sessions: int, seed: int, step: float = 0.04) -> DataFrame:
    """asset, session, open, high, low, close: a random walk of log prices that starts at 100; each open is the close before."""
    rows = spark.range(assets * sessions).select((F.col("id") % assets).alias("asset"), F.floor(F.col("id") / assets).alias("session"))
    a, s = F.col("asset").cast("string"), F.col("session").cast("string")
    rows = rows.withColumn("move", (uniform(F.lit(str(seed)), a, s) - 0.5) * step).withColumn("_w", uniform(F.lit(str(seed)), a, s, F.lit("w")) * step / 4)
    path = Window.partitionBy("asset").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("close", 100 * F.exp(F.sum("move").over(path))).withColumn("open", F.col("close") / F.exp("move"))
    return rows.select("asset", "session", "open", (F.greatest("open", "close") * (1 + F.col("_w"))).alias("high"), (F.least("open", "close") * (1 - F.col("_w"))).alias("low"), "close")
