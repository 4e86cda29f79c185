"""Market features, cross-sections and labels (W, A, F ids of the survey)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.core import correlation
from ..operators import market, quality
from ..sources import adapters as src
from .registry import query, r, rounded

W = "WINDOW w AS (PARTITION BY asset_id ORDER BY ts)"
RET = "CASE WHEN lag({p}) OVER w = 0 THEN 0.0 ELSE {p} / lag({p}) OVER w - 1 END"


def _lagged(k: int) -> str:
    return f"coalesce(close / lag(close, {k}) OVER w - 1, 0.0) AS return_{k}d, lag(close, {k}) OVER w IS NULL AS return_{k}d_missing"


@query("W01_returns", f"""WITH {src.BARS}, f AS (SELECT asset_id, ts, {', '.join(_lagged(k) for k in (1, 3, 5, 20, 60))} FROM bars {W})
SELECT asset_id, ts, {', '.join(r(f'return_{k}d') + f', return_{k}d_missing' for k in (1, 3, 5, 20, 60))},
  round(-return_1d, 6) + 0.0::DOUBLE AS short_term_reversal_1d, round(return_20d, 6) + 0.0::DOUBLE AS momentum_20d,
  round(CASE WHEN return_5d_missing THEN 0.0 ELSE return_5d - return_1d END, 6) + 0.0::DOUBLE AS momentum_5d FROM f""")
def w01(spark, sf):
    names = [c for k in market.RETURNS for c in (f"return_{k}d", f"return_{k}d_missing")]
    return rounded(market.returns(src.bars(spark, sf)).select("asset_id", "ts", *names, "short_term_reversal_1d", "momentum_20d", "momentum_5d"))


@query("W04_liquidity", f"""WITH {src.BARS}, b AS (SELECT *, close * volume AS dollar_volume, close / lag(close) OVER w - 1 AS ret FROM bars {W}),
f AS (SELECT asset_id, ts, dollar_volume, coalesce(open / lag(close) OVER w - 1, 0.0) AS gap_return_1d, lag(close) OVER w IS NULL AS gap_return_1d_missing, close / open - 1 AS intraday_return,
  coalesce(volume / nullif(avg(volume) OVER (PARTITION BY asset_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0), 1.0) AS abnormal_volume_3d,
  coalesce(volume / nullif(avg(volume) OVER (PARTITION BY asset_id ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0), 1.0) AS abnormal_volume_20d,
  avg(dollar_volume) OVER (PARTITION BY asset_id ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS average_dollar_volume_20d,
  coalesce(avg(CASE WHEN dollar_volume > 0 THEN abs(ret) / dollar_volume END) OVER (PARTITION BY asset_id ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0.0) AS amihud_illiquidity_20d,
  least(20, row_number() OVER w - 1) AS volume_history_count, (high - low) / ((high + low) / 2) AS high_low_spread_estimate FROM b {W})
SELECT asset_id, ts, {r('dollar_volume', 'gap_return_1d', 'intraday_return', 'abnormal_volume_3d', 'abnormal_volume_20d', 'average_dollar_volume_20d', 'high_low_spread_estimate')},
  gap_return_1d_missing, round(amihud_illiquidity_20d, 12) AS amihud_illiquidity_20d, round(ln(1 + average_dollar_volume_20d), 6) AS size_proxy_log_dollar_volume, volume_history_count::BIGINT AS volume_history_count FROM f""")
def w04(spark, sf):
    f = market.liquidity(src.bars(spark, sf)).select(
        "asset_id", "ts", "dollar_volume", "gap_return_1d", "intraday_return", "abnormal_volume_3d", "abnormal_volume_20d", "average_dollar_volume_20d", "high_low_spread_estimate", "gap_return_1d_missing",
        "amihud_illiquidity_20d", "size_proxy_log_dollar_volume", "volume_history_count")
    amihud = F.round("amihud_illiquidity_20d", 12)
    return rounded(f.withColumn("_a", amihud.cast("string"))).withColumn("amihud_illiquidity_20d", F.col("_a").cast("double")).drop("_a")


@query("W08_volatility", f"""WITH {src.BARS}, b AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM bars {W}),
f AS (SELECT asset_id, ts,
  coalesce(stddev_pop(ret) OVER w3, 0.0) AS realized_volatility_3d, count(ret) OVER w3 < 2 AS realized_volatility_3d_missing, coalesce(stddev_pop(ret) OVER w20, 0.0) AS realized_volatility_20d,
  coalesce(stddev_pop(ret) OVER w60, 0.0) AS realized_volatility_60d, coalesce(stddev_pop(CASE WHEN ret < 0 THEN ret WHEN ret >= 0 THEN 0.0 END) OVER w20, 0.0) AS downside_volatility_20d,
  sqrt(avg(ln(high / low) * ln(high / low)) OVER w20 / (4 * ln(2))) AS high_low_volatility_20d FROM b
  WINDOW w3 AS (PARTITION BY asset_id ORDER BY ts ROWS 2 PRECEDING), w20 AS (PARTITION BY asset_id ORDER BY ts ROWS 19 PRECEDING), w60 AS (PARTITION BY asset_id ORDER BY ts ROWS 59 PRECEDING))
SELECT asset_id, ts, realized_volatility_3d_missing, {r('realized_volatility_3d', 'realized_volatility_20d', 'realized_volatility_60d', 'downside_volatility_20d', 'high_low_volatility_20d')},
  round(CASE WHEN realized_volatility_60d > 1e-12 THEN realized_volatility_20d / realized_volatility_60d ELSE 0.0 END, 6) AS volatility_regime FROM f""")
def w08(spark, sf):
    return rounded(market.volatility(src.bars(spark, sf)).select("asset_id", "ts", "realized_volatility_3d_missing", "realized_volatility_3d", "realized_volatility_20d", "realized_volatility_60d",
                                                                 "downside_volatility_20d", "high_low_volatility_20d", "volatility_regime"))


@query("W12_market_model", f"""WITH {src.ASSETS}, {src.BARS}, b AS (SELECT asset_id, ts, close / lag(close) OVER w - 1 AS ret FROM bars {W}),
c AS (SELECT b.*, sector, avg(ret) OVER (PARTITION BY ts) AS m, avg(ret) OVER (PARTITION BY ts, sector) AS s FROM b LEFT JOIN assets USING (asset_id)),
d AS (SELECT *, CASE WHEN count(ret) OVER w60 >= 2 THEN covar_pop(ret, CASE WHEN ret IS NOT NULL THEN m END) OVER w60 / nullif(var_pop(CASE WHEN ret IS NOT NULL THEN m END) OVER w60, 0) END AS beta
  FROM c WINDOW w60 AS (PARTITION BY asset_id ORDER BY ts ROWS 59 PRECEDING))
SELECT asset_id, ts, round(coalesce(beta, 0.0), 2) + 0.0::DOUBLE AS market_beta_60d, beta IS NULL AS market_beta_60d_missing, round(coalesce(m, 0.0), 6) + 0.0::DOUBLE AS market_return_1d,
  round(coalesce(ret - beta * m, 0.0), 2) + 0.0::DOUBLE AS market_residual_return_1d, round(s, 6) + 0.0::DOUBLE AS sector_return_1d, round(ret - s, 6) + 0.0::DOUBLE AS sector_residual_return_1d, s IS NULL AS sector_data_missing FROM d""")
def w12(spark, sf):
    f = market.market_model(src.bars(spark, sf), src.assets(spark, sf)).select("asset_id", "ts", "market_beta_60d", "market_beta_60d_missing", "market_return_1d", "market_residual_return_1d",
                                                                               "sector_return_1d", "sector_residual_return_1d", "sector_data_missing")
    coarse = {c: F.round(c, 2) + F.lit(0.0) for c in ("market_beta_60d", "market_residual_return_1d")}  # window covariances differ in the last digits
    return rounded(f.withColumns(coarse))


def _labels_sql(h: int) -> str:
    moves = " + ".join(f"power(p{k} / p{k - 1} - 1, 2)" for k in range(1, h + 1))
    return f"""l0 AS (SELECT *, lead(open) OVER w AS p0, {', '.join(f'lead(close, {k}) OVER w AS p{k}, lead(volume, {k}) OVER w AS v{k}' for k in range(1, h + 1))},
    lead(ts) OVER w AS s1, lead(ts, {h}) OVER w AS se, lead(seq, {h}) OVER w = seq + {h} AS whole FROM bars {W}),
  labels AS (SELECT asset_id, ts, seq, close, open, volume, CASE WHEN whole THEN p{h} / p0 - 1 END AS forward_return, CASE WHEN whole THEN sqrt(({moves}) / {h}) END AS forward_volatility,
    CASE WHEN whole THEN ({' + '.join(f'v{k}' for k in range(1, h + 1))}) / {h} END AS forward_volume, CASE WHEN whole THEN s1 END AS label_start, CASE WHEN whole THEN se END AS label_end, seq + {h} AS expected_end_seq FROM l0)"""


LABELS = _labels_sql(1)


@query("W17_forward_labels", f"""WITH {src.BARS}, {_labels_sql(3)} SELECT asset_id, ts, {r('forward_return', 'forward_volatility', 'forward_volume')}, label_start, label_end, expected_end_seq,
  round(forward_volume / volume - 1, 6) + 0.0::DOUBLE AS forward_volume_change, (forward_return > 0)::INTEGER::VARCHAR AS binary_up, CASE WHEN forward_return IS NULL THEN 'incomplete_sessions' END AS missing_reason FROM labels""")
def w17(spark, sf):
    return rounded(market.forward_labels(src.bars(spark, sf), 3).select("asset_id", "ts", "forward_return", "forward_volatility", "forward_volume", "label_start", "label_end", "expected_end_seq",
                                                                        "forward_volume_change", F.col("binary_up").cast("string").alias("binary_up"), "missing_reason"))


def labelled(spark, sf, h: int = 1):
    return market.forward_labels(src.bars(spark, sf), h).join(src.assets(spark, sf), "asset_id")


CROSS = """x AS (SELECT *, avg(forward_return) OVER (PARTITION BY ts) AS m, avg(forward_return) OVER (PARTITION BY ts, sector) AS s, count(forward_return) OVER (PARTITION BY ts) AS n,
  rank() OVER (PARTITION BY ts, forward_return IS NULL ORDER BY forward_return) - 1 + (count(*) OVER (PARTITION BY ts, forward_return) - 1) / 2.0 AS k FROM labels JOIN assets USING (asset_id))"""


@query("W19_cross_section", f"""WITH {src.ASSETS}, {src.BARS}, {LABELS}, {CROSS}
SELECT asset_id, ts, round(m, 6) + 0.0::DOUBLE AS market_forward_return, round(forward_return - m, 6) + 0.0::DOUBLE AS abnormal_forward_return, round(forward_return - s, 6) + 0.0::DOUBLE AS sector_neutral_forward_return,
  round(CASE WHEN forward_return IS NULL THEN NULL WHEN n = 1 THEN 0.5 ELSE k / (n - 1) END, 6)::DOUBLE AS rank_pct FROM x""")
def w19(spark, sf):
    return rounded(market.cross_section(labelled(spark, sf)).select("asset_id", "ts", "market_forward_return", "abnormal_forward_return", "sector_neutral_forward_return", "rank_pct"))


@query("W23_holdout_split", f"""WITH {src.BARS}, {LABELS}, t AS (SELECT DISTINCT ts FROM labels WHERE forward_return IS NOT NULL), k AS (SELECT ts, row_number() OVER (ORDER BY ts DESC) <= 20 AS holdout FROM t)
SELECT ts, holdout FROM k""")
def w23(spark, sf):
    t = market.forward_labels(src.bars(spark, sf), 1).where("forward_return is not null").select("ts").distinct()
    return t.withColumn("holdout", F.row_number().over(Window.orderBy(F.desc("ts"))) <= 20)  # one row per decision


@query("W25_rebalance_sampling", f"""WITH {src.BARS}, t AS (SELECT DISTINCT ts FROM bars), k AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM t) SELECT ts, i::BIGINT AS i FROM k WHERE i >= 2 AND (i - 2) % 4 = 0""")
def w25(spark, sf):
    t = src.bars(spark, sf).select("ts").distinct().withColumn("i", (F.row_number().over(Window.orderBy("ts")) - 1).cast("long"))
    return t.where((F.col("i") >= 2) & (F.pmod(F.col("i") - 2, F.lit(4)) == 0))


@query("W27_score_delay", f"""WITH {src.BARS}, s AS (SELECT asset_id, ts, close / lag(close) OVER w - 1 AS score FROM bars {W}), d AS (SELECT asset_id, ts, lag(score, 2) OVER w AS delayed_score FROM s {W})
SELECT asset_id, ts, round(delayed_score, 6) + 0.0::DOUBLE AS delayed_score FROM d WHERE delayed_score IS NOT NULL""")
def w27(spark, sf):
    s = src.bars(spark, sf).withColumn("score", F.col("close") / F.lag("close").over(market.by_asset()) - 1)
    return rounded(s.select("asset_id", "ts", F.lag("score", 2).over(market.by_asset()).alias("delayed_score")).where("delayed_score is not null"))


@query("A01_market_sector_returns", f"""WITH {src.ASSETS}, {src.BARS}, b AS (SELECT asset_id, ts, close / lag(close) OVER w - 1 AS ret FROM bars {W})
SELECT ts, coalesce(sector, 'ALL') AS sector, round(avg(ret), 6) + 0.0::DOUBLE AS mean_return, count(ret) AS n FROM b JOIN assets USING (asset_id) WHERE ret IS NOT NULL GROUP BY GROUPING SETS ((ts), (ts, sector))""")
def a01(spark, sf):
    b = src.bars(spark, sf).withColumn("ret", F.col("close") / F.lag("close").over(market.by_asset()) - 1).join(src.assets(spark, sf), "asset_id").where("ret is not null")
    both = b.withColumn("sector", F.explode(F.array(F.lit("ALL"), F.col("sector"))))
    return rounded(both.groupBy("ts", "sector").agg(F.avg("ret").alias("mean_return"), F.count("ret").alias("n")))


@query("A06_beta_correlation", f"""WITH {src.BARS}, b AS (SELECT asset_id, ts, close / lag(close) OVER w - 1 AS ret FROM bars {W}), c AS (SELECT *, avg(ret) OVER (PARTITION BY ts) AS m FROM b)
SELECT asset_id, count(ret) AS n, round(coalesce(covar_pop(ret, m) / nullif(var_pop(CASE WHEN ret IS NOT NULL THEN m END), 0), 0.0), 3) + 0.0::DOUBLE AS beta,
  round(coalesce(covar_pop(ret, m) / nullif(sqrt(var_pop(ret) * var_pop(CASE WHEN ret IS NOT NULL THEN m END)), 0), 0.0), 3) + 0.0::DOUBLE AS correlation,
  round(coalesce(stddev_pop(ret), 0.0), 6) AS std, round(sqrt(avg(ret * ret)), 6) AS rms FROM c GROUP BY asset_id""")
def a06(spark, sf):
    b = src.bars(spark, sf).withColumn("ret", F.col("close") / F.lag("close").over(market.by_asset()) - 1)
    b = b.withColumn("m", F.avg("ret").over(Window.partitionBy("ts"))).withColumn("m", F.when(F.col("ret").isNotNull(), F.col("m")))
    out = b.groupBy("asset_id").agg(F.count("ret").alias("n"), F.coalesce(F.try_divide(F.covar_pop("ret", "m"), F.var_pop("m")), F.lit(0.0)).alias("beta"), correlation(F.col("ret"), F.col("m")).alias("correlation"),
                                    F.coalesce(F.stddev_pop("ret"), F.lit(0.0)).alias("std"), F.sqrt(F.avg(F.col("ret") * F.col("ret"))).alias("rms"))
    return rounded(out.withColumns({c: F.round(c, 3) + F.lit(0.0) for c in ("beta", "correlation")}))


@query("F04_contiguity", f"""WITH {src.BARS}, g AS (SELECT asset_id, ts, seq, lag(seq) OVER w AS previous FROM bars {W}) SELECT asset_id, ts, seq - previous - 1 AS missing_sessions FROM g WHERE seq <> previous + 1""")
def f04(spark, sf):
    g = src.bars(spark, sf).withColumn("previous", F.lag("seq").over(market.by_asset()))
    return g.where(F.col("seq") != F.col("previous") + 1).select("asset_id", "ts", (F.col("seq") - F.col("previous") - 1).alias("missing_sessions"))


@query("F05_bar_contract", f"""WITH {src.ASSETS}, {src.BARS}, days AS (SELECT DISTINCT ts FROM bars),
a AS (SELECT asset_id, name AS symbol, CASE WHEN asset_id IN ('N1', 'N2') THEN DATE '1994-06-06' END AS s, CASE WHEN asset_id IN ('N2', 'N5') THEN DATE '1997-01-01' END AS e FROM assets WHERE asset_id <> 'N9'),
b AS (SELECT asset_id, ts, CASE WHEN asset_id = 'N7' AND seq % 10 = 0 THEN 'other' ELSE name END AS symbol FROM bars JOIN assets USING (asset_id) WHERE seq % 17 <> 3 OR asset_id = 'N4'),
own AS (SELECT b.asset_id, ts, a.asset_id IS NULL AS u, coalesce(b.symbol <> a.symbol, FALSE) AS m, coalesce(ts < s, FALSE) OR coalesce(ts > e, FALSE) AS o FROM b LEFT JOIN a ON a.asset_id = b.asset_id)
SELECT asset_id, ts, array_to_string(list_filter([CASE WHEN u THEN 'unknown_asset' END, CASE WHEN m THEN 'symbol_mismatch' END, CASE WHEN o THEN 'outside_active_period' END], lambda x: x IS NOT NULL), ',') AS broken FROM own WHERE u OR m OR o
UNION ALL SELECT asset_id, days.ts, 'missing_bar' FROM a JOIN days ON (s IS NULL OR days.ts >= s) AND (e IS NULL OR days.ts <= e) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.asset_id = a.asset_id AND b.ts = days.ts)""")
def f05(spark, sf):
    all_assets, bars = src.assets(spark, sf), src.bars(spark, sf)
    day = lambda d, *ids: F.when(F.col("asset_id").isin(*ids), F.lit(d).cast("date"))
    a = all_assets.where("asset_id <> 'N9'").select("asset_id", F.col("name").alias("symbol"), day("1994-06-06", "N1", "N2").alias("active_from"), day("1997-01-01", "N2", "N5").alias("active_to"))
    b = bars.join(all_assets, "asset_id").where("seq % 17 <> 3 or asset_id = 'N4'").select("asset_id", "ts", F.when((F.col("asset_id") == "N7") & (F.col("seq") % 10 == 0), "other").otherwise(F.col("name")).alias("symbol"))
    sessions = bars.select("ts").distinct().withColumn("seq", F.row_number().over(Window.orderBy("ts")).cast("long"))  # one row a session
    return quality.bar_contract(b, a, sessions).select("asset_id", "ts", F.array_join("broken", ",").alias("broken"))


@query("F08_complete_cross_sections", f"""WITH {src.ASSETS}, {src.BARS}, {LABELS}, last AS (SELECT max(seq) AS z FROM bars)
SELECT ts, count(*) AS n, count(forward_return) AS observed, CASE WHEN count(forward_return) = count(*) THEN 'observed' WHEN count(forward_return) = 0 AND min(expected_end_seq) > max(z) THEN 'censored' ELSE 'partial' END AS status
FROM labels, last GROUP BY ts""")
def f08(spark, sf):
    l = market.forward_labels(src.bars(spark, sf), 1)
    z = src.bars(spark, sf).agg(F.max("seq").alias("z")).scalar()
    g = l.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.count("forward_return").alias("observed"), F.min("expected_end_seq").alias("least"))
    status = F.when(F.col("observed") == F.col("n"), "observed").when((F.col("observed") == 0) & (F.col("least") > z), "censored").otherwise("partial")
    return g.select("ts", "n", "observed", status.alias("status"))


@query("F10_development_cutoff", f"""WITH {src.BARS}, {LABELS} SELECT ts, count(*) AS n, bool_and(coalesce(label_end < DATE '1999-01-04', FALSE)) AS keep, bool_or(coalesce(label_end < DATE '1999-01-04', FALSE)) AND NOT bool_and(coalesce(label_end < DATE '1999-01-04', FALSE)) AS partial FROM labels GROUP BY ts""")
def f10(spark, sf):
    before = F.coalesce(F.col("label_end") < F.lit("1999-01-04").cast("date"), F.lit(False))
    g = market.forward_labels(src.bars(spark, sf), 1).groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.bool_and(before).alias("keep"), F.bool_or(before).alias("some"))
    return g.select("ts", "n", "keep", (F.col("some") & ~F.col("keep")).alias("partial"))
