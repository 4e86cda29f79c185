"""Views of the plain test tables as the engine's records, and the same views as SQL.

Assets are nations, a bar is a nation's week of line items, signals are orders, and
daily bars are the event stream by type. Times are dates, so that no session zone
enters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table over all cores where it has fewer splits than there are (one row group is one split); larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def day(c: Column) -> Column:
    return F.unix_date(c).cast("long")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("asset_id"), F.col("n_name").alias("name"), F.col("r_name").alias("sector"))


ASSETS = "assets AS (SELECT 'N' || n_nationkey AS asset_id, n_name AS name, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey)"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = l.join(s, l.l_suppkey == s.s_suppkey).withColumn("p", price).withColumn("o", order)
    out = rows.groupBy(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("asset_id"), F.trunc(F.col("l_shipdate").cast("date"), "week").alias("ts")).agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum(F.col("l_quantity").cast("double")).alias("volume"))
    return out.withColumn("seq", F.expr("(unix_date(ts) + 3) div 7").cast("long"))


BARS = """bars AS (
  SELECT 'N' || s_nationkey AS asset_id, date_trunc('week', l_shipdate)::DATE AS ts,
    arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS close,
    sum(l_quantity::DOUBLE) AS volume,
    ((date_trunc('week', l_shipdate)::DATE - DATE '1970-01-01') + 3) // 7 AS seq
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    mood = F.when(F.col("o_orderpriority").startswith("1"), 1.0).when(F.col("o_orderpriority").startswith("2"), 0.5).when(F.col("o_orderpriority").startswith("5"), -1.0).when(
        F.col("o_orderpriority").startswith("4"), -0.5).otherwise(0.0)
    rows = o.join(c, o.o_custkey == c.c_custkey).select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("asset_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").cast("date").alias("available_at"),
        mood.alias("sentiment"), F.col("c_mktsegment").alias("source_type"), F.col("o_custkey").alias("author"), F.col("o_orderstatus").alias("event_type"),
        (0.5 + (F.floor("o_totalprice") % 1000) / 2000.0).alias("confidence"), ((F.floor("o_totalprice") % 100) / 100.0).alias("relevance"), ((F.col("o_custkey") % 10) / 20.0).alias("spam"),
        ((F.col("o_custkey") % 5 + 5) / 10.0).alias("credibility"))
    first = Window.partitionBy("author", "event_type").orderBy("available_at", "item_id")
    return rows.withColumn("novelty", F.when(F.row_number().over(first) == 1, 1.0).otherwise(0.0))


SIGNALS = """signals AS (
  SELECT 'N' || c_nationkey AS asset_id, o_orderkey AS item_id, o_orderdate::DATE AS available_at,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 1.0::DOUBLE WHEN '2' THEN 0.5 WHEN '5' THEN -1.0 WHEN '4' THEN -0.5 ELSE 0.0 END AS sentiment,
    c_mktsegment AS source_type, o_custkey AS author, o_orderstatus AS event_type,
    0.5::DOUBLE + (floor(o_totalprice) % 1000) / 2000.0::DOUBLE AS confidence, (floor(o_totalprice) % 100) / 100.0::DOUBLE AS relevance, (o_custkey % 10) / 20.0::DOUBLE AS spam,
    (o_custkey % 5 + 5) / 10.0::DOUBLE AS credibility,
    CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate::DATE, o_orderkey) = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS novelty
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("asset_id"), F.col("ts").cast("date").alias("ts"), "value", "event_id", F.col("user_id"))
    return e.groupBy("asset_id", "ts").agg(F.sum("value").alias("volume"), F.avg("value").alias("close"), F.count(F.lit(1)).alias("n"))


DAILY = "daily AS (SELECT event_type AS asset_id, ts::DATE AS ts, sum(value) AS volume, avg(value) AS close, count(*) AS n FROM events GROUP BY ALL)"
