"""Per-asset market features over row windows, cross-section returns and forward labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.core import average_rank, beta_over, simple_return, zero_if_null

RETURNS = (1, 3, 5, 20, 60)


def by_asset() -> WindowSpec:
    return Window.partitionBy("asset_id").orderBy("ts")


def _rows(before: int, to: int = 0):
    return by_asset().rowsBetween(-before, to)


def returns(bars: DataFrame) -> DataFrame:
    """return_{1,3,5,20,60}d (0.0 and a missing flag without enough history), reversal and momentum; p is the price."""
    out = bars.withColumn("p", F.col("close") * F.coalesce("factor", F.lit(1.0)) if "factor" in bars.columns else F.col("close"))
    for k in RETURNS:
        r = simple_return(F.col("p"), F.lag("p", k).over(by_asset()))
        out = out.withColumn(f"return_{k}d", zero_if_null(r)).withColumn(f"return_{k}d_missing", F.lag("p", k).over(by_asset()).isNull())
    return out.withColumns({
        "short_term_reversal_1d": -F.col("return_1d"), "momentum_20d": F.col("return_20d"),
        "momentum_5d": F.when(F.col("return_5d_missing"), 0.0).otherwise(F.col("return_5d") - F.col("return_1d"))})


def liquidity(bars: DataFrame) -> DataFrame:
    """Gap and intraday returns, abnormal volume (the current row left out), dollar volume, 21-row average, Amihud, spread."""
    r = F.when(F.lag("close").over(by_asset()).isNotNull(), simple_return(F.col("close"), F.lag("close").over(by_asset())))
    out = bars.withColumn("dollar_volume", F.col("close") * F.col("volume")).withColumn("_r", r)
    gap = simple_return(F.col("open"), F.lag("close").over(by_asset()))
    out = out.withColumns({"gap_return_1d": zero_if_null(gap), "gap_return_1d_missing": gap.isNull(), "intraday_return": simple_return(F.col("close"), F.col("open"))})
    for n in (3, 20):
        mean = F.avg("volume").over(_rows(n, -1))
        out = out.withColumn(f"abnormal_volume_{n}d", F.when(mean.isNull() | (mean == 0), 1.0).otherwise(F.try_divide(F.col("volume"), mean))).withColumn(f"abnormal_volume_{n}d_missing", mean.isNull())
    adv = F.avg("dollar_volume").over(_rows(20))
    illiquid = F.avg(F.when((F.col("dollar_volume") > 0) & F.col("_r").isNotNull(), F.try_divide(F.abs("_r"), F.col("dollar_volume")))).over(_rows(19))
    return out.withColumns({
        "average_dollar_volume_20d": adv, "amihud_illiquidity_20d": zero_if_null(illiquid), "size_proxy_log_dollar_volume": F.log1p(adv),
        "volume_history_count": F.least(F.lit(20), F.row_number().over(by_asset()) - 1).cast("long"),
        "high_low_spread_estimate": F.try_divide(F.col("high") - F.col("low"), (F.col("high") + F.col("low")) / 2)}).drop("_r")


def volatility(bars: DataFrame) -> DataFrame:
    """Realised, downside and range volatility and the regime; 0.0 and a flag with fewer than two returns."""
    out = bars.withColumn("_r", simple_return(F.col("close"), F.lag("close").over(by_asset())))
    for n in (3, 20, 60):
        w = _rows(n - 1)
        out = out.withColumn(f"realized_volatility_{n}d", zero_if_null(F.stddev_pop("_r").over(w))).withColumn(f"realized_volatility_{n}d_missing", F.count("_r").over(w) < 2)
    down = F.when(F.col("_r").isNotNull(), F.least("_r", F.lit(0.0)))
    ranged = F.avg(F.pow(F.log(F.col("high") / F.col("low")), F.lit(2.0))).over(_rows(19))
    return out.withColumns({
        "downside_volatility_20d": zero_if_null(F.stddev_pop(down).over(_rows(19))), "high_low_volatility_20d": F.sqrt(ranged / (4 * math.log(2))),
        "volatility_regime": F.when(F.col("realized_volatility_60d") > 0, F.try_divide(F.col("realized_volatility_20d"), F.col("realized_volatility_60d"))).otherwise(0.0)}).drop("_r")


def market_model(bars: DataFrame, assets: DataFrame) -> DataFrame:
    """Market and sector returns of each time, beta over 60 rows and residuals."""
    out = bars.withColumn("_r", simple_return(F.col("close"), F.lag("close").over(by_asset()))).join(assets.select("asset_id", "sector"), "asset_id", "left")
    named = F.when(F.trim("sector") != "", F.col("_r"))
    out = out.withColumns({"_m": F.avg("_r").over(Window.partitionBy("ts")), "_s": F.avg(named).over(Window.partitionBy("ts", "sector"))})
    beta = beta_over(F.col("_r"), F.col("_m"), _rows(59))
    out = out.withColumn("_beta", beta)
    return out.withColumns({
        "market_beta_60d": zero_if_null(F.col("_beta")), "market_beta_60d_missing": F.col("_beta").isNull(), "market_return_1d": zero_if_null(F.col("_m")),
        "market_residual_return_1d": zero_if_null(F.col("_r") - F.col("_beta") * F.col("_m")), "sector_return_1d": F.col("_s"), "sector_residual_return_1d": F.col("_r") - F.col("_s"),
        "sector_data_missing": F.col("_s").isNull()}).drop("_beta", "_m", "_s", "_r")


def forward_labels(bars: DataFrame, h: int) -> DataFrame:
    """Labels of horizon ``h``: enter at the next session's open, leave at the h-th session's close.

    A gap in the sessions of the window censors the label (null).
    """
    steps = [F.lead("close", k).over(by_asset()) for k in range(1, h + 1)]
    whole = F.lead("seq", h).over(by_asset()) == F.col("seq") + h
    entry, leave = F.lead("open", 1).over(by_asset()), F.lead("close", h).over(by_asset())
    path = F.array(entry, *steps)
    moves = F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: simple_return(F.get(path, k), F.get(path, k - 1)))
    rms = F.sqrt(F.aggregate(moves, F.lit(0.0), lambda s, x: s + x * x) / h)
    volume = sum((F.lead("volume", k).over(by_asset()) for k in range(1, h + 1)), F.lit(0.0)) / h
    out = bars.withColumns({
        "forward_return": F.when(whole, simple_return(leave, entry)), "forward_volatility": F.when(whole, rms), "forward_volume": F.when(whole, volume),
        "label_start": F.when(whole, F.lead("ts", 1).over(by_asset())), "label_end": F.when(whole, F.lead("ts", h).over(by_asset())), "expected_end_seq": F.col("seq") + h})
    return out.withColumns({"forward_volume_change": F.when(F.col("volume") > 0, F.try_divide(F.col("forward_volume"), F.col("volume")) - 1),
                            "binary_up": (F.col("forward_return") > 0).cast("int"), "missing_reason": F.when(F.col("forward_return").isNull(), "incomplete_sessions")})


def cross_section(labels: DataFrame, by: str = "ts", value: str = "forward_return") -> DataFrame:
    """Market mean, abnormal and sector-neutral value, and the average-tie percent rank (0.5 for a single one; null unranked)."""
    w, s = Window.partitionBy(by), Window.partitionBy(by, "sector")
    ranked = Window.partitionBy(by, F.col(value).isNull())
    n = F.count(value).over(w)
    rank = average_rank(F.col(value), ranked, ranked.orderBy(value), Window.partitionBy(by, value))
    return labels.withColumns({
        "market_forward_return": F.avg(value).over(w), "abnormal_forward_return": F.col(value) - F.avg(value).over(w), "sector_neutral_forward_return": F.col(value) - F.avg(value).over(s),
        "rank_pct": F.when(F.col(value).isNotNull(), F.when(n == 1, 0.5).otherwise(F.try_divide(rank, n - 1)))})
