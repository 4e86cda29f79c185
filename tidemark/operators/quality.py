"""Data-quality assertions: each returns the rows that violate a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins


class QualityError(ValueError):
    """Rows that violate a rule were found."""


def assert_empty(violations: DataFrame, message: str, show: int = 5) -> None:
    rows = violations.limit(show).collect()
    if rows:
        raise QualityError(f"{message}: {[r.asDict() for r in rows]}")


def future_inputs(rows: DataFrame, asof: str = "asof_ts") -> DataFrame:
    """Rows any of whose availability columns (scalars or arrays) lies after ``asof``."""
    bad: Column = F.lit(False)
    for name, kind in rows.dtypes:
        if "available_at" in name:
            late = F.exists(F.col(name), lambda x: x > F.col(asof)) if kind.startswith("array") else F.col(name) > F.col(asof)
            bad = bad | F.coalesce(late, F.lit(False))
    return rows.where(bad)


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, n of keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unknown_references(rows: DataFrame, master: DataFrame, key: str) -> DataFrame:
    return rows.join(master.select(key).distinct(), key, "left_anti")


def bar_contract(bars: DataFrame, assets: DataFrame, sessions: DataFrame) -> DataFrame:
    """asset_id, ts, broken: bars of unknown assets, of another symbol or outside the asset's active period, and sessions without a bar of an active asset.

    ``bars``: asset_id, ts, symbol. ``assets``: asset_id, symbol, active_from, active_to (null: open).
    ``sessions``: ts, seq (gapless numbers). Expected bars come from the numbers alone, so no sides are crossed.
    """
    a = assets.select("asset_id", F.col("symbol").alias("_symbol"), "active_from", "active_to", F.lit(True).alias("_known"))
    after = F.coalesce(F.col("ts") >= F.col("active_from"), F.lit(True)) & F.coalesce(F.col("ts") <= F.col("active_to"), F.lit(True))
    known = F.col("_known").isNotNull()
    own = bars.join(a, "asset_id", "left").withColumn("broken", F.array_compact(F.array(
        F.when(~known, "unknown_asset"), F.when(known & ~F.col("symbol").eqNullSafe(F.col("_symbol")), "symbol_mismatch"), F.when(known & ~after, "outside_active_period"))))
    first, last = sessions.agg(F.min("seq"), F.max("seq")).first()
    bounds = sessions.select(F.col("ts").alias("_ts"), "seq")
    starts = joins.asof_forward(a.select("asset_id", F.coalesce("active_from", F.lit("0001-01-01").cast("date")).alias("_at")).withColumn("_one", F.lit(1)), bounds.withColumn("_one", F.lit(1)), ["_one"], "_at", "_ts", ["seq"], strict=False)
    ends = joins.asof_backward(a.select("asset_id", F.coalesce("active_to", F.lit("9999-12-31").cast("date")).alias("_at")).withColumn("_one", F.lit(1)), bounds.withColumn("_one", F.lit(1)), ["_one"], "_at", "_ts", ["seq"])
    spans = starts.select("asset_id", F.coalesce("seq", F.lit(last + 1)).alias("s")).join(ends.select("asset_id", F.coalesce("seq", F.lit(first - 1)).alias("e")), "asset_id").where("s <= e")
    expected = spans.select("asset_id", F.explode(F.sequence("s", "e")).alias("seq")).join(sessions.select("ts", "seq"), "seq").select("asset_id", "ts")
    missing = expected.join(bars.select("asset_id", "ts"), ["asset_id", "ts"], "left_anti").withColumn("broken", F.array(F.lit("missing_bar")))
    return own.where(F.size("broken") > 0).select("asset_id", "ts", "broken").unionByName(missing)


def all_or_none(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Groups in which a column is given for some rows but not for all."""
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("given"))
    return g.where((F.col("given") > 0) & (F.col("given") < F.col("n")))


def incomplete_pairs(rows: DataFrame, left: DataFrame, right: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """Expected pairs that are missing, for two small sides given as complete lists (at most some thousand rows each)."""
    a, b = keys
    some = right.agg(F.array_sort(F.collect_set(b)).alias("all")).scalar()
    expected = left.select(a).distinct().withColumn(b, F.explode(some))
    return expected.join(rows.select(a, b).distinct(), [a, b], "left_anti")


def off_calendar(rows: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """Rows whose day is no session of the calendar (a table of one row per session)."""
    return rows.join(calendar.select(day), day, "left_anti")


def outcome_rows(labels: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Rows of the decisions whose every label is known and lies inside [start, end]."""
    inside = F.coalesce((F.col("label_start") >= F.lit(start).cast("date")) & (F.col("label_end") <= F.lit(end).cast("date")), F.lit(False))
    whole = labels.groupBy(at).agg(F.bool_and(inside).alias("w")).where("w").select(at)
    return labels.join(whole, at, "left_semi")


def forbidden_keys(rows: DataFrame, column: str, reserved: list[str]) -> DataFrame:
    """Rows whose JSON object has a reserved key."""
    keys = F.json_object_keys(F.col(column))
    return rows.where(F.arrays_overlap(keys, F.array(*map(F.lit, reserved))))
