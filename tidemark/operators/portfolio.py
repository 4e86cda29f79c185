"""Constrained portfolios and their replay with costs, set-based: every step is a window sum per decision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import rule_flags
from ..functions.costs import CostModel


@dataclass(frozen=True)
class Limits:
    max_position_weight: float = 0.2
    max_sector_weight: float = 0.35
    max_gross_exposure: float = 0.9
    max_net_exposure: float = 0.5
    max_beta_exposure: float = 0.4
    max_daily_turnover: float = 0.8
    max_participation_rate: float = 0.05
    min_price: float = 5.0
    min_dollar_volume: float = 1000.0
    shorting_allowed: bool = True
    hard_to_borrow_allowed: bool = False


def eligibility(rows: DataFrame, limits: Limits) -> DataFrame:
    """Adds ``reasons``: why a weight is not eligible (empty if it is)."""
    short = F.col("weight") < 0
    return rows.withColumn("reasons", rule_flags(
        ("missing_market_data", F.col("close").isNull()), ("min_price", F.coalesce("close", F.lit(0.0)) < limits.min_price),
        ("min_dollar_volume", F.coalesce("dollar_volume", F.lit(0.0)) < limits.min_dollar_volume), ("shorting_disabled", short & F.lit(not limits.shorting_allowed)),
        ("short_unavailable", short & ~F.coalesce("short_available", F.lit(False))), ("hard_to_borrow", short & F.coalesce("hard_to_borrow", F.lit(False)) & F.lit(not limits.hard_to_borrow_allowed))))


def top_k(rows: DataFrame, k: int, by: list[str], limits: Limits) -> DataFrame:
    """The k largest |score| of each decision (ties by asset), as plus or minus the largest position."""
    r = rows.where((F.col("score") > 0) | ((F.col("score") < 0) & F.lit(limits.shorting_allowed)))
    r = r.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs("score")), "asset_id"))).where(F.col("_k") <= k).drop("_k")
    return r.withColumn("weight", F.signum("score") * limits.max_position_weight)


def constrain(rows: DataFrame, by: list[str], limits: Limits, equity: float = 1.0) -> DataFrame:
    """Weights of each decision within all limits, from a flat book: sector, gross, net, beta, turnover, participation, and a last common scale.

    Needs weight, sector, beta, dollar_volume; blank sectors share 'UNKNOWN'.
    """
    w, s = Window.partitionBy(*by), Window.partitionBy(*by, "sector")
    cap = lambda total, limit: F.when(total > limit, F.try_divide(F.lit(limit), total)).otherwise(1.0)
    r = rows.withColumn("sector", F.coalesce(F.nullif(F.trim("sector"), F.lit("")), F.lit("UNKNOWN")))
    r = r.withColumn("weight", F.col("weight") * cap(F.sum(F.abs("weight")).over(s), limits.max_sector_weight))
    r = r.withColumn("weight", F.col("weight") * cap(F.sum(F.abs("weight")).over(w), limits.max_gross_exposure))
    r = r.withColumns({"_l": F.sum(F.greatest("weight", F.lit(0.0))).over(w), "_s": -F.sum(F.least("weight", F.lit(0.0))).over(w)})
    net = F.col("_l") - F.col("_s")
    long_scale = F.when(net > limits.max_net_exposure, F.try_divide(F.col("_s") + limits.max_net_exposure, F.col("_l"))).otherwise(1.0)
    short_scale = F.when(net < -limits.max_net_exposure, F.try_divide(F.col("_l") + limits.max_net_exposure, F.col("_s"))).otherwise(1.0)
    r = r.withColumn("weight", F.col("weight") * F.when(F.col("weight") > 0, long_scale).otherwise(short_scale)).drop("_l", "_s")
    r = r.withColumn("weight", F.col("weight") * cap(F.abs(F.sum(F.col("weight") * F.col("beta")).over(w)), limits.max_beta_exposure))
    r = r.withColumn("weight", F.col("weight") * cap(F.sum(F.abs("weight")).over(w), limits.max_daily_turnover))
    part = F.try_divide(F.abs("weight") * equity, F.col("dollar_volume"))
    most = limits.max_participation_rate * F.col("dollar_volume") / equity
    r = r.withColumn("weight", F.when(F.col("dollar_volume") <= 0, 0.0).when(part > limits.max_participation_rate, F.signum("weight") * most).otherwise(F.col("weight")))
    r = r.withColumns({"_g": F.sum(F.abs("weight")).over(w), "_n": F.abs(F.sum("weight").over(w)), "_b": F.abs(F.sum(F.col("weight") * F.col("beta")).over(w)), "_x": F.sum(F.abs("weight")).over(s)})
    r = r.withColumn("_x", F.max("_x").over(w))
    scale = F.least(F.lit(1.0), cap(F.col("_g"), limits.max_gross_exposure), cap(F.col("_n"), limits.max_net_exposure), cap(F.col("_b"), limits.max_beta_exposure), cap(F.col("_x"), limits.max_sector_weight))
    r = r.withColumn("weight", F.col("weight") * scale).drop("_g", "_n", "_b", "_x")
    return r.where(F.abs("weight") > 1e-12).withColumn("participation", F.try_divide(F.abs("weight") * equity, F.col("dollar_volume")))


def exposures(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, gross, net, beta, long, short and a map of sector gross."""
    sector = rows.groupBy(*by, "sector").agg(F.sum(F.abs("weight")).alias("g"), F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("beta")).alias("b"))
    return sector.groupBy(*by).agg(F.sum("g").alias("gross"), F.sum("n").alias("net"), F.sum("b").alias("beta"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("sector", "g")))).alias("sectors"))


def periods(book: DataFrame, by: list[str], costs: CostModel) -> DataFrame:
    """One row per decision: gross and net return, cost components, turnover, participation and capacity.

    ``book``: weight, forward_return, volatility, participation, dollar_volume, holding_days. Two-sided: the
    exit trades the drifted weight.
    """
    exit_weight = F.col("weight") * (1 + F.col("forward_return"))
    one = costs.columns(F.col("weight"), F.col("volatility"), F.col("participation"), F.least(F.lit(0.0), F.col("weight")), F.col("holding_days"))
    two = costs.columns(exit_weight, F.col("volatility"), F.col("participation"), F.lit(0.0), F.lit(0.0))
    parts = ["commission", "spread", "slippage", "market_impact", "borrow"]
    r = book.withColumns({f"_{p}": one[p] + two[p] for p in parts})
    out = r.groupBy(*by).agg(
        F.sum(F.col("weight") * F.col("forward_return")).alias("gross_return"), *(F.sum(f"_{p}").alias(f"{p}_return") for p in parts), F.sum(F.abs("weight")).alias("gross_exposure"),
        F.sum("weight").alias("net_exposure"), (F.sum(F.col("weight") * F.col("beta")) if "beta" in book.columns else F.lit(None).cast("double")).alias("beta_exposure"), F.avg("holding_days").alias("holding_days"), F.sum(F.abs("weight") + F.abs(exit_weight)).alias("turnover"), F.max("participation").alias("max_participation_rate"),
        F.min(F.try_divide(F.col("dollar_volume") * 0.05, F.abs("weight"))).alias("capacity_proxy_equity"), F.count(F.lit(1)).alias("trades"))
    out = out.withColumn("cost_return", sum((F.col(f"{p}_return") for p in parts), F.lit(0.0)))
    return out.withColumn("net_return", F.col("gross_return") - F.col("cost_return"))


def equity_curve(p: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """Adds equity (compounded max(0, 1 + net)), peak and drawdown; a period that loses everything ends the curve at zero."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    growth = F.greatest(F.lit(0.0), 1 + F.col("net_return"))
    r = p.withColumn("equity", F.when(F.min(growth).over(w) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(F.greatest(growth, F.lit(1e-300)))).over(w))))
    r = r.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    return r.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def summary(p: DataFrame, order: str, periods_per_year: float = 52.0, by: list[str] | None = None) -> DataFrame:
    """Backtest metrics in one row (or one for each group)."""
    by = by or []
    c = equity_curve(p, order, by)
    w = Window.partitionBy(*(by or [F.lit(0)]))
    n = F.count(F.lit(1)).over(w)
    c = c.withColumn("_low", F.row_number().over(w.orderBy("net_return")) <= F.greatest(F.lit(1), F.floor(n * 0.05)))
    mean, vol, down = F.avg("net_return"), F.stddev_pop("net_return"), F.stddev_pop(F.least(F.lit(0.0), F.col("net_return")))
    year = F.sqrt(F.lit(periods_per_year))
    last, gross = F.max_by("equity", order), F.greatest(F.lit(0.0), 1 + F.col("gross_return"))
    compounded = F.when(F.min(gross) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(F.greatest(gross, F.lit(1e-300))))))
    parts = ["commission", "spread", "slippage", "market_impact", "borrow"]
    out = c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("periods"), (last - 1).alias("total_return"), (compounded - 1).alias("gross_total_return"), (last - 1).alias("cost_adjusted_return"), mean.alias("mean_return"), (vol * year).alias("annualized_volatility"),
        F.coalesce(F.try_divide(mean, vol) * year, F.lit(0.0)).alias("sharpe"), F.coalesce(F.try_divide(mean, down) * year, F.lit(0.0)).alias("sortino"), F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(F.col("net_return") > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(F.when(F.col("_low"), F.col("net_return"))).alias("tail_loss_5pct"), F.avg("turnover").alias("average_turnover"),
        F.avg("cost_return").alias("average_cost_return"), F.sum("cost_return").alias("total_cost_return"), F.avg("gross_exposure").alias("average_gross_exposure"), F.avg("net_exposure").alias("average_net_exposure"),
        F.coalesce(F.avg("beta_exposure"), F.lit(0.0)).alias("average_beta_exposure"), F.max("max_participation_rate").alias("max_participation_rate"),
        F.coalesce(F.min(F.when(F.col("capacity_proxy_equity") > 0, F.col("capacity_proxy_equity"))), F.lit(0.0)).alias("minimum_capacity_proxy_equity"),
        F.coalesce(F.try_divide(F.sum(F.col("holding_days") * F.col("trades")), F.sum("trades").cast("double")), F.lit(0.0)).alias("average_holding_period_days"), last.alias("final_equity"), F.sum("trades").alias("trades"),
        *(F.sum(f"{x}_return").alias(f"total_{x}_return") for x in parts))
    return out.withColumn("annualized_return", annualized(F.col("total_return"), F.col("periods"), periods_per_year))


def violations(book: DataFrame, by: list[str], limits: Limits, tolerance: float = 1e-10) -> DataFrame:
    """by, violated: the names of the limits that the weights of a decision break, in a fixed order."""
    s = book.groupBy(*by, "sector").agg(F.max(F.abs("weight")).alias("p"), F.sum(F.abs("weight")).alias("g"), F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("beta")).alias("b"))
    over = lambda c, limit: c > limit + tolerance
    return s.groupBy(*by).agg(rule_flags(
        ("max_position_weight", over(F.max("p"), limits.max_position_weight)), ("max_gross_exposure", over(F.sum("g"), limits.max_gross_exposure)),
        ("max_net_exposure", over(F.abs(F.sum("n")), limits.max_net_exposure)), ("max_beta_exposure", over(F.abs(F.sum("b")), limits.max_beta_exposure)),
        ("max_sector_weight", over(F.max("g"), limits.max_sector_weight))).alias("violated"))


def entry_budget(limits: Limits, round_trip: bool = True, buffer: float = 0.25) -> dict[str, float]:
    """Turnover and participation left for entries, when the exit of a round trip must fit in as well."""
    if not round_trip:
        return {"max_daily_turnover": limits.max_daily_turnover, "max_participation_rate": limits.max_participation_rate}
    return {"max_daily_turnover": limits.max_daily_turnover / (2 + buffer), "max_participation_rate": limits.max_participation_rate / (1 + buffer)}


def annualized(total_return: Column, periods: Column, periods_per_year: float) -> Column:
    """Compound yearly return; -1 once everything is lost, 0 without periods."""
    return F.when(periods <= 0, 0.0).when(total_return <= -1, -1.0).otherwise(F.pow(1 + total_return, periods_per_year / periods) - 1)


def replay_checks(book: DataFrame, by: list[str], limits: Limits, tolerance: float = 1e-9) -> DataFrame:
    """by, participation_ok, turnover_ok, prices_ok: what a replay asserts of the weights that it trades."""
    return book.groupBy(*by).agg((F.max("participation") <= limits.max_participation_rate + tolerance).alias("participation_ok"), (F.sum(F.abs("weight")) <= limits.max_daily_turnover + tolerance).alias("turnover_ok"),
                                 (F.min("close") > 0).alias("prices_ok"))
