"""Paper trading as tables: fills accumulate into positions and cash, marked to the latest price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.costs import CostModel
from .statistics import seeded_shuffle


def positions(fills: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds position (quantity held after each fill, per account and asset). ``fills``: quantity (signed), price."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return fills.withColumn("position", F.sum("quantity").over(w))


def snapshot(fills: DataFrame, account: str, asset: str, order: list[str], cash: float) -> DataFrame:
    """account, cash, market_value, equity, open_positions after all fills, each position at its last traded price."""
    held = fills.groupBy(account, asset).agg(F.sum("quantity").alias("q"), F.max_by("price", F.struct(*order)).alias("p"), F.sum(F.col("quantity") * F.col("price")).alias("paid"))
    return held.groupBy(account).agg((F.lit(cash) - F.sum("paid")).alias("cash"), F.sum(F.col("q") * F.col("p")).alias("market_value"), F.count_if(F.abs("q") > 1e-12).alias("open_positions")).withColumn(
        "equity", F.col("cash") + F.col("market_value"))


def simulate(book: DataFrame, at: str, costs: CostModel, capital: float = 1.0) -> DataFrame:
    """at, trades, turnover, cost_return, gross_return, equity: a paper account that rebalances to the targets of each decision and is marked before the next.

    ``book``: at, asset_id, weight (target), forward_return (until the next decision), volatility,
    participation. What is held drifts with the returns, so a decision trades from the drifted to the
    new weights, and sells what is no target any more. Equity is after the mark; it ends at zero
    once a loss takes everything.
    """
    order = book.select(at).distinct().withColumn("_n", F.row_number().over(Window.orderBy(at)))  # one row a decision
    own = book.join(order, at)
    gross = own.groupBy("_n").agg(F.sum(F.col("weight") * F.col("forward_return")).alias("gross_return"))
    growth = F.greatest(F.lit(0.0), 1 + F.col("gross_return"))
    held = own.join(gross, "_n").select((F.col("_n") + 1).alias("_n"), "asset_id", F.when(growth > 0, F.col("weight") * (1 + F.col("forward_return")) / growth).otherwise(0.0).alias("_held"))
    moves = own.select("_n", "asset_id", "weight", "volatility", "participation").join(held, ["_n", "asset_id"], "full_outer").join(order, "_n")  # nothing is traded after the last decision
    delta = F.coalesce("weight", F.lit(0.0)) - F.coalesce("_held", F.lit(0.0))
    zero = F.lit(0.0)
    parts = costs.columns(F.col("_d"), F.coalesce("volatility", zero), F.coalesce("participation", zero), zero, zero)
    traded = moves.withColumn("_d", delta).groupBy("_n", at).agg(F.count_if(F.abs("_d") > 1e-12).alias("trades"), F.sum(F.abs("_d")).alias("turnover"), F.sum(parts["total"]).alias("cost_return"))
    both = traded.join(gross, "_n")
    step = F.greatest(zero, 1 - F.col("cost_return")) * F.greatest(zero, 1 + F.col("gross_return"))
    w = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)  # one row a decision
    equity = F.when(F.min(step).over(w) <= 0, 0.0).otherwise(F.lit(capital) * F.exp(F.sum(F.log(F.greatest(step, F.lit(1e-300)))).over(w)))
    return both.select(at, "trades", "turnover", "cost_return", "gross_return", equity.alias("equity"))


def intents(rows: DataFrame, at: str, weight: str, account_equity: float, sessions: DataFrame | None = None) -> DataFrame:
    """Orders of the latest decision: asset, side, target weight, notional and, given ``sessions`` (column ``at``), the session at whose open they go out."""
    last = rows.agg(F.max(at).alias("t")).scalar()
    r = rows.where(F.col(at) == last)
    out = r.select("asset_id", at, F.when(F.col(weight) > 0, "buy").otherwise("sell").alias("side"), F.col(weight).alias("target_weight"), (F.abs(weight) * account_equity).alias("notional"))
    if sessions is None:
        return out
    return out.withColumn("next_open", sessions.where(F.col(at) > rows.agg(F.max(at).alias("t")).scalar()).agg(F.min(at).alias("n")).scalar())


def scenarios(scores: DataFrame, at: str, key: list[str], shift: int, delay: int, ablations: dict[str, Column] | None = None, shuffle_seed: int | None = None) -> DataFrame:
    """The scored rows once per scenario (column ``scenario``), all to go through one backtest.

    baseline; without the last or first ``shift`` decisions; scores delayed by ``delay`` decisions of
    their key; source_ablation:<name> with the score that was made without that source; and, with a
    seed, shuffled_text: the scores of each decision permuted among its rows.
    """
    d = scores.select(at).distinct()
    k = d.select(at, F.row_number().over(Window.orderBy(at)).alias("_a"), F.row_number().over(Window.orderBy(F.desc(at))).alias("_z"))  # one row per decision
    late = F.lag("score", delay).over(Window.partitionBy(*key).orderBy(at))
    s = scores.join(k, at).withColumn("_late", late)
    named = lambda n, c: F.struct(F.lit(n).alias("scenario"), c.cast("double").alias("score"))
    own = F.col("score")
    pick = F.array_compact(F.array(
        named("baseline", own), F.when(F.col("_z") > shift, named("endpoint_shift_early", own)), F.when(F.col("_a") > shift, named("endpoint_shift_late", own)), F.when(F.col("_late").isNotNull(), named("causal_delay", F.col("_late"))),
        *(named(f"source_ablation:{n}", c) for n, c in (ablations or {}).items())))
    out = s.withColumn("_s", F.explode(pick)).drop("_a", "_z", "_late", "score").select("*", "_s.*").drop("_s")
    if shuffle_seed is None:
        return out
    mixed = seeded_shuffle(scores, [at], key[0], "score", shuffle_seed).withColumn("scenario", F.lit("shuffled_text")).withColumn("score", own.cast("double"))
    return out.unionByName(mixed)
