"""Models, evaluation, portfolios, backtests and statistics (M, A, T, C18, P ids of the survey)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import core
from ..functions.core import holm
from ..functions.costs import CostModel
from ..operators import accounts, market, models, portfolio, statistics, training
from ..sources import adapters as src
from ..sources.checkpoints import settle
from .market import LABELS
from .registry import query, r, rounded

FEATURES = ["momentum", "volume_shift", "spread"]

FEAT = """feat AS (SELECT asset_id, ts, (ts - DATE '1970-01-01')::BIGINT AS decision, coalesce(ln(close / lag(close) OVER w), 0.0) AS momentum, coalesce(ln(volume / lag(volume) OVER w), 0.0) AS volume_shift,
  (high - low) / ((high + low) / 2) AS spread FROM bars WINDOW w AS (PARTITION BY asset_id ORDER BY ts))"""
ROWS = "rows_ AS (SELECT f.*, ln(1 + l.forward_return) AS y, (l.label_end - DATE '1970-01-01')::BIGINT AS avail FROM feat f LEFT JOIN labels l USING (asset_id, ts))"
BASE = f"{src.BARS}, {LABELS}, {FEAT}, {ROWS}"
LONG = "long AS (" + " UNION ALL ".join(f"SELECT asset_id, ts, decision, avail, y, '{f}' AS feature, {f} AS x FROM rows_" for f in FEATURES) + ")"
SNAP = """sums AS (SELECT feature, avail, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(y * y) AS syy, sum(x * y) AS sxy FROM long WHERE y IS NOT NULL AND avail IS NOT NULL GROUP BY ALL),
run AS (SELECT feature, avail, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sxx) OVER w AS sxx, sum(sy) OVER w AS sy, sum(syy) OVER w AS syy, sum(sxy) OVER w AS sxy FROM sums WINDOW w AS (PARTITION BY feature ORDER BY avail)),
dec AS (SELECT DISTINCT decision, feature FROM long),
st AS (SELECT d.decision, d.feature, coalesce(r.n, 0) AS n, r.sx / r.n AS mean, r.sxx / r.n - power(r.sx / r.n, 2) AS vx, r.syy / r.n - power(r.sy / r.n, 2) AS vy, r.sxy / r.n - r.sx * r.sy / r.n / r.n AS c
  FROM dec d ASOF LEFT JOIN run r ON r.feature = d.feature AND r.avail < d.decision),
co AS (SELECT *, CASE WHEN n >= 2 AND vx > 1e-12 AND vy > 1e-12 THEN c / sqrt(vx * vy) ELSE 0.0 END AS r FROM st),
snap AS (SELECT decision, feature, n, CASE WHEN n >= 20 THEN mean ELSE 0.0 END AS mean, CASE WHEN n >= 20 AND vx > 1e-12 THEN sqrt(vx) ELSE 1.0 END AS scale,
  CASE WHEN n >= 20 AND sum(abs(r)) OVER (PARTITION BY decision) > 0 THEN r / sum(abs(r)) OVER (PARTITION BY decision) ELSE 0.0 END AS weight FROM co)"""
PRED = "pred AS (SELECT asset_id, ts, sum((x - mean) / scale * weight) AS score FROM long JOIN snap USING (decision, feature) GROUP BY ALL)"
SCORED = "scored AS (SELECT p.asset_id, p.ts, round(p.score, 5) + 0.0::DOUBLE AS score, l.y FROM pred p JOIN rows_ l USING (asset_id, ts) WHERE l.y IS NOT NULL)"


def rows(spark, sf):
    w = market.by_asset()
    b = src.bars(spark, sf)
    change = lambda c: F.coalesce(F.log(F.col(c) / F.lag(c).over(w)), F.lit(0.0))
    f = b.select("asset_id", "ts", src.day(F.col("ts")).alias("decision"), change("close").alias("momentum"), change("volume").alias("volume_shift"), ((F.col("high") - F.col("low")) / ((F.col("high") + F.col("low")) / 2)).alias("spread"))
    l = market.forward_labels(b, 1).select("asset_id", "ts", F.log(1 + F.col("forward_return")).alias("y"), src.day(F.col("label_end")).alias("avail"))
    return f.join(l, ["asset_id", "ts"], "left")


def scored(spark, sf):
    x = rows(spark, sf)
    p = models.predict(x, models.walk_forward(x, FEATURES), FEATURES, ["asset_id", "ts"])
    return p.join(x.select("asset_id", "ts", "y"), ["asset_id", "ts"]).where("y is not null").withColumn("score", F.round("score", 5) + F.lit(0.0))


@query("M01_walk_forward", f"WITH {BASE}, {LONG}, {SNAP} SELECT decision, feature, n::BIGINT AS n, {r('mean', 'scale', 'weight', digits=4)} FROM snap")
def m01(spark, sf):
    return rounded(models.walk_forward(rows(spark, sf), FEATURES), 4)


@query("M03_predictions", f"WITH {BASE}, {LONG}, {SNAP}, {PRED} SELECT asset_id, ts, round(score, 4) + 0.0::DOUBLE AS score FROM pred")
def m03(spark, sf):
    x = rows(spark, sf)
    return rounded(models.predict(x, models.walk_forward(x, FEATURES), FEATURES, ["asset_id", "ts"]), 4)


FAMILIES = {"price": ["momentum", "spread"], "flow": ["volume_shift"], "combined": ["momentum", "volume_shift", "spread"]}
EMBARGO, LAST = 2, 20
# Whole cross-sections, their windows and cutoffs, and the families' snapshots; ``return_1d`` stands for momentum.
PROTOCOL = f"""pr AS (SELECT *, momentum AS return_1d FROM rows_), xs AS (SELECT decision, count(*) = count(y) AS seen, max(avail) AS known_at FROM pr GROUP BY decision),
pl AS (SELECT decision, known_at, row_number() OVER (ORDER BY decision DESC) AS back FROM xs WHERE seen), hs AS (SELECT max(decision) FILTER (WHERE back = {LAST}) AS s FROM pl),
fl AS (SELECT min(decision) AS d FROM pl, hs WHERE back > {LAST} AND known_at >= s), win AS (SELECT decision, CASE WHEN back <= {LAST} THEN 'final_holdout' WHEN decision >= (SELECT d FROM fl) THEN 'purged' ELSE 'development' END AS "window" FROM pl),
dx AS (SELECT decision, row_number() OVER (ORDER BY decision) AS i FROM (SELECT DISTINCT decision FROM pr)),
cx AS (SELECT a.decision, a.decision >= s AS frozen, greatest(1, CASE WHEN a.decision >= s THEN (SELECT i FROM dx, hs WHERE dx.decision = s) ELSE a.i END - {EMBARGO}) AS j FROM dx a, hs), cu AS (SELECT c.decision, b.decision AS cutoff, frozen FROM cx c JOIN dx b ON b.i = c.j),
us AS (SELECT pr.*, ('0x' || md5(asset_id || '@' || decision)[1:15])::BIGINT AS k FROM pr JOIN xs USING (decision), hs WHERE seen AND avail IS NOT NULL AND decision < s),
ul AS ({' UNION ALL '.join(f"SELECT avail, decision, asset_id, y, k, '{f}' AS feature, coalesce({f}, 0.0) AS x FROM us" for f in FEATURES)}),
ag AS (SELECT cutoff, feature, count(x) AS n, avg(x) AS mean, var_pop(x) AS vx, var_pop(y) AS vy, corr(x, y) AS rho, coalesce(sum(k), 0)::VARCHAR AS keys FROM (SELECT DISTINCT cutoff FROM cu) LEFT JOIN ul ON avail < cutoff GROUP BY ALL),
fam AS (SELECT unnest({[f for f, own in FAMILIES.items() for _ in own]}) AS family, unnest({[x for own in FAMILIES.values() for x in own]}) AS feature),
gr AS (SELECT decision, cutoff, frozen, family, fam.feature, coalesce(n, 0) AS n, mean, vx, vy, keys, CASE WHEN vx > 1e-12 AND vy > 1e-12 THEN rho ELSE 0.0 END AS rho FROM cu CROSS JOIN fam LEFT JOIN ag USING (cutoff, feature)),
sn AS (SELECT decision, cutoff, CASE WHEN frozen THEN 'frozen_final_holdout' ELSE 'development_walk_forward' END AS role, family, feature, CASE WHEN n >= 20 THEN n ELSE 0 END AS n, CASE WHEN n >= 20 THEN mean ELSE 0.0 END AS mean, CASE WHEN n >= 20 AND vx > 1e-12 THEN sqrt(vx) ELSE 1.0 END AS scale,
  CASE WHEN n >= 20 AND sum(abs(rho)) OVER (PARTITION BY decision, family) > 0 THEN rho / sum(abs(rho)) OVER (PARTITION BY decision, family) ELSE 0.0 END AS weight, CASE WHEN n >= 20 AND vy > 1e-12 THEN sqrt(vy) ELSE 0.0 END AS residual_scale, CASE WHEN n >= 20 THEN keys ELSE '0' END AS key_digest FROM gr)"""
_LONG = " UNION ALL ".join(f"SELECT asset_id, decision, '{f}' AS feature, coalesce({f}, 0.0) AS x FROM pr" for f in FEATURES)
FORECAST = f"""fc AS (SELECT family, asset_id, decision, sum((x - mean) / scale * weight) AS score, max(residual_scale) AS uncertainty, max(n)::BIGINT AS training_rows FROM ({_LONG}) JOIN sn USING (decision, feature) GROUP BY ALL
  UNION ALL SELECT b.family, asset_id, decision, CASE b.family WHEN 'equal_weight' THEN 1.0 WHEN 'momentum_only' THEN return_1d ELSE 0.0 END, NULL, 0 FROM pr, (SELECT unnest(['equal_weight', 'momentum_only', 'no_trade']) AS family) b)"""


def protocol_rows(spark, sf):
    """Written once: windows, cutoffs, sums and predictions each read them."""
    return settle(rows(spark, sf).withColumn("return_1d", F.col("momentum")))


def snapshots(x, holdout=LAST):
    return training.train(x, FAMILIES, F.concat("asset_id", F.lit("@"), F.col("decision").cast("string")), 20, EMBARGO, holdout, strict=False)


@query("M01_embargo_and_holdout", f"WITH {BASE}, {PROTOCOL} SELECT decision, cutoff, role, family, feature, n::BIGINT AS n, {r('mean', 'scale', 'weight', 'residual_scale', digits=4)}, key_digest FROM sn")
def m01_protocol(spark, sf):
    return rounded(snapshots(protocol_rows(spark, sf)), 4)


@query("M03_families_with_uncertainty", f"WITH {BASE}, {PROTOCOL}, {FORECAST} SELECT family, asset_id, decision, {r('score', 'uncertainty', digits=4)}, training_rows FROM fc")
def m03_families(spark, sf):
    x = protocol_rows(spark, sf)
    return rounded(training.predict(x, snapshots(x), FAMILIES, ["asset_id"]), 4)


RANKED = """rk AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY score) - 1 + (count(*) OVER (PARTITION BY ts, score) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY ts ORDER BY y) - 1 + (count(*) OVER (PARTITION BY ts, y) - 1) / 2.0 AS ry FROM s)"""


@query("A16_daily_ic", f"""WITH {src.BARS}, {LABELS}, s AS (SELECT asset_id, ts, close - open AS score, forward_return AS y FROM labels WHERE forward_return IS NOT NULL), {RANKED}
SELECT ts, count(*) AS n, round(coalesce(covar_pop(score, y) / nullif(sqrt(var_pop(score) * var_pop(y)), 0), 0.0), 5) + 0.0::DOUBLE AS pearson, round(coalesce(covar_pop(rs, ry) / nullif(sqrt(var_pop(rs) * var_pop(ry)), 0), 0.0), 5) + 0.0::DOUBLE AS spearman FROM rk GROUP BY ts""")
def a16(spark, sf):
    l = market.forward_labels(src.bars(spark, sf), 1).where("forward_return is not null").select("asset_id", "ts", (F.col("close") - F.col("open")).alias("score"), F.col("forward_return").alias("y"))
    return rounded(models.daily_ic(l, ["ts"]), 5)


def metrics_sql(source: str, by: str, at: str, k: int) -> str:
    """SQL: the diagnostics of ``models.prediction_metrics`` over a table of by, at, score, y and expected."""
    rank = lambda g, v: f"rank() OVER (PARTITION BY {g} ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0"
    corr = lambda x, y: f"coalesce(covar_pop({x}, {y}) / nullif(sqrt(var_pop({x}) * var_pop({y})), 0), 0.0)"
    precision = lambda g: f"""SELECT {g}, sum(CASE WHEN y > 0 THEN least(1.0, (depth - k + 1) / t::DOUBLE) ELSE 0.0 END) / max(depth) AS p FROM (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY score DESC) AS k,
      count(*) OVER (PARTITION BY {g}, score) AS t, least({k}, count(*) OVER (PARTITION BY {g})) AS depth FROM {source}) WHERE k <= depth GROUP BY {g}"""  # noqa: E731
    both = f"{by}, {at}"
    return f"""mrk AS (SELECT *, {rank(by, 'score')} AS rs, {rank(by, 'y')} AS ry, {rank(both, 'score')} AS ds, {rank(both, 'y')} AS dy FROM {source}),
mhead AS (SELECT {by}, count(*) AS "rows", count(DISTINCT {at}) AS dates, avg(CASE WHEN score * y > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, CASE WHEN count(expected) = count(*) THEN avg(power(expected - y, 2)) END AS mean_squared_error, {corr('score', 'y')} AS pearson_ic, {corr('rs', 'ry')} AS spearman_ic FROM mrk GROUP BY {by}),
mday AS (SELECT {by}, count(*) AS ic_dates, avg(p) AS mean_daily_pearson_ic, avg(s) AS mean_daily_spearman_ic FROM (SELECT {both}, {corr('score', 'y')} AS p, {corr('ds', 'dy')} AS s FROM mrk GROUP BY {both} HAVING count(*) >= 2) GROUP BY {by}),
mtop AS ({precision(by)}), mtopd AS (SELECT {by}, avg(p) AS p FROM ({precision(both)}) GROUP BY {by}),
metrics AS (SELECT {by}, "rows", dates, coalesce(ic_dates, 0) AS ic_dates, {r('pearson_ic', 'spearman_ic')}, round(coalesce(mean_daily_pearson_ic, 0.0), 6) + 0.0::DOUBLE AS mean_daily_pearson_ic, round(coalesce(mean_daily_spearman_ic, 0.0), 6) + 0.0::DOUBLE AS mean_daily_spearman_ic,
  round(hit_rate, 6)::DOUBLE AS hit_rate, round(mtop.p, 6)::DOUBLE AS precision_at_k, round(mtopd.p, 6)::DOUBLE AS mean_daily_precision_at_k, round(mean_squared_error, 6) AS mean_squared_error
  FROM mhead LEFT JOIN mday USING ({by}) JOIN mtop USING ({by}) JOIN mtopd USING ({by}))"""


# Outcomes squeezed to (-1, 1): prices of the test tables jump, and a few rows would decide every average.
_SCORED = """sq AS (SELECT l.asset_id, l.ts, l.close, l.volume, b.high, b.low, (l.close - l.open) / (l.close + l.open) AS score, forward_return / (2 + forward_return) AS y, (l.close - l.open) / l.close / 10 AS expected
  FROM labels l JOIN bars b ON b.asset_id = l.asset_id AND b.ts = l.ts WHERE forward_return IS NOT NULL)"""


def squeezed(spark, sf):
    l = market.forward_labels(src.bars(spark, sf), 1).where("forward_return is not null")
    c, o, y = (F.col(n) for n in ("close", "open", "forward_return"))
    return l.select("asset_id", "ts", "close", "volume", "high", "low", ((c - o) / (c + o)).alias("score"), (y / (2 + y)).alias("y"), ((c - o) / c / 10).alias("expected"))


_JUDGED = """ev AS (SELECT f.family || ':' || w."window" AS fw, f.decision, round(f.score, 5) + 0.0::DOUBLE AS score, pr.y, NULL::DOUBLE AS expected FROM fc f JOIN pr USING (asset_id, decision) JOIN win w USING (decision) WHERE w."window" <> 'purged')"""


@query("M05_holdout_evaluation", f"""WITH {BASE}, {PROTOCOL}, {FORECAST}, {_JUDGED}, {metrics_sql('ev', 'fw', 'decision', 10)} SELECT split_part(fw, ':', 1) AS family, split_part(fw, ':', 2) AS "window", * EXCLUDE (fw) FROM metrics""")
def m05_holdout(spark, sf):
    x = protocol_rows(spark, sf)
    p = training.predict(x, snapshots(x), FAMILIES, ["asset_id"]).withColumn("score", F.round("score", 5) + F.lit(0.0))
    return rounded(training.evaluate(settle(p), x.select("asset_id", "decision", "avail", "y"), ["asset_id", "decision"], LAST))


@query("F22_protocol_violations", f"""WITH {BASE}, {PROTOCOL}, h AS (SELECT min(decision) AS s, count(*) AS n FROM win WHERE "window" = 'final_holdout'), z AS (SELECT min(decision) AS d, min(cutoff) AS c, max(n)::BIGINT AS t, max(key_digest) AS k FROM sn WHERE role = 'frozen_final_holdout')
SELECT shift, s + 7 * (shift % 2) AS holdout_start, n + shift // 2 % 2 AS holdout_periods, d AS frozen_decision, c + 700 * (shift // 4) AS cutoff, t AS training_rows, k AS key_digest,
  array_to_string(list_filter([CASE WHEN shift % 2 = 1 THEN 'holdout_start' END, CASE WHEN shift // 2 % 2 = 1 THEN 'holdout_periods' END, CASE WHEN c + 700 * (shift // 4) > s THEN 'cutoff_after_start' END, CASE WHEN shift // 4 = 1 THEN 'updated_in_holdout' END], lambda e: e IS NOT NULL), ',') AS broken
FROM h, z, (SELECT unnest(range(8)) AS shift)""")
def f22_protocol(spark, sf):
    """The protocol as it is (0) and with every set of three faults: another start, one period more, a cutoff 100 weeks later."""
    x = protocol_rows(spark, sf)
    s = settle(snapshots(x))
    shift, bit = F.col("shift"), lambda b: F.expr(f"shift div {b} % 2")
    claims = training.protocol(x, s, LAST).join(spark.range(8).select(F.col("id").alias("shift")), how="cross").withColumns({"holdout_start": F.col("holdout_start") + 7 * (shift % 2), "holdout_periods": F.col("holdout_periods") + bit(2), "cutoff": F.col("cutoff") + 700 * bit(4)})
    return training.protocol_violations(claims, x, s, LAST).withColumn("broken", F.array_join("broken", ","))


@query("A16_prediction_metrics", f"""WITH {src.BARS}, {LABELS}, {_SCORED}, sg AS (SELECT 'all' AS segment, * FROM sq), {metrics_sql('sg', 'segment', 'ts', 10)} SELECT * FROM metrics""")
def a16b(spark, sf):
    return rounded(models.prediction_metrics(squeezed(spark, sf).withColumn("segment", F.lit("all")), ["segment"], "ts", 10))


TIES = "s AS (SELECT asset_id, ts, round(close / 100) AS score, forward_return AS y FROM labels WHERE forward_return IS NOT NULL)"


@query("A17_precision_at_k", f"""WITH {src.BARS}, {LABELS}, {TIES}, d AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY ts, score) AS t, least(5, count(*) OVER (PARTITION BY ts)) AS depth FROM s)
SELECT ts, round(sum(CASE WHEN y > 0 THEN least(1.0, (depth - k + 1) / t::DOUBLE) ELSE 0.0 END) / max(depth), 6)::DOUBLE AS precision FROM d WHERE k <= depth GROUP BY ts""")
def a17(spark, sf):
    l = market.forward_labels(src.bars(spark, sf), 1).where("forward_return is not null").select("ts", F.round(F.col("close") / 100).alias("score"), F.col("forward_return").alias("y"))
    return rounded(models.precision_at_k(l, ["ts"], 5))


PROB = "pr AS (SELECT d.doc_id, least(1.0, n_chars / 4000.0)::DOUBLE AS p, quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def probabilities(spark, sf):
    d, l = src.table(spark, sf, "documents"), src.table(spark, sf, "labels")
    return d.join(l, "doc_id").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("p"), F.col("quality").alias("y"), "lang", "source")


@query("A18_calibration", f"WITH {PROB} SELECT least(9, floor(p * 10))::INTEGER AS bin, count(*) AS \"rows\", round(avg(p), 6) AS mean_probability, round(avg(y::DOUBLE), 6) AS observed_rate FROM pr GROUP BY 1")
def a18(spark, sf):
    return rounded(models.calibration(probabilities(spark, sf)))


@query("A18_brier_ece", f"WITH {PROB}, b AS (SELECT least(9, floor(p * 10)) AS bin, count(*) AS n, avg(p) AS mp, avg(y::DOUBLE) AS r FROM pr GROUP BY 1) SELECT (SELECT count(*) FROM pr) AS \"rows\", round((SELECT avg(power(p - y, 2)) FROM pr), 6) AS brier, round((SELECT sum(n * abs(mp - r)) / sum(n) FROM b), 6) AS ece")
def a18b(spark, sf):
    return rounded(models.classification(probabilities(spark, sf)))


@query("A19_segments", f"""WITH {src.ASSETS}, {src.BARS}, {LABELS}, {src.SIGNALS}, {_SCORED},
told AS (SELECT asset_id, date_trunc('week', available_at)::DATE AS ts, list_distinct(list(source_type)) AS sources, list_distinct(list(event_type)) AS events FROM signals WHERE novelty > 0.5 GROUP BY ALL),
cx AS (SELECT sq.*, sector, CASE WHEN close * volume * 200 < 5e6 THEN 'low' WHEN close * volume * 200 < 5e7 THEN 'medium' ELSE 'high' END AS liquidity,
  CASE WHEN (high - low) / close / 50 < 0.01 THEN 'low' WHEN (high - low) / close / 50 < 0.03 THEN 'normal' ELSE 'high' END AS volatility, coalesce(sources, []) AS sources, coalesce(events, []) AS events FROM sq JOIN assets USING (asset_id) LEFT JOIN told USING (asset_id, ts)),
sg AS (SELECT dimension || ': ' || value AS segment, ts, score, y, expected FROM (SELECT *, unnest([{{'dimension': 'sector', 'value': sector}}, {{'dimension': 'liquidity_bucket', 'value': liquidity}}, {{'dimension': 'volatility_regime', 'value': volatility}},
    {{'dimension': 'source_availability', 'value': CASE WHEN len(sources) > 0 THEN 'available' ELSE 'missing' END}}, {{'dimension': 'event_availability', 'value': CASE WHEN len(events) > 0 THEN 'available' ELSE 'missing' END}}]
    || list_transform(sources, lambda x: {{'dimension': 'source_type', 'value': x}}) || list_transform(events, lambda x: {{'dimension': 'event_type', 'value': x}}), recursive := true) FROM cx) WHERE coalesce(value, '') <> ''),
{metrics_sql('sg', 'segment', 'ts', 5)} SELECT * FROM metrics""")
def a19(spark, sf):
    heard = src.signals(spark, sf).where("novelty > 0.5").groupBy("asset_id", F.trunc("available_at", "week").alias("ts")).agg(F.collect_set("source_type").alias("sources"), F.collect_set("event_type").alias("events"))
    none = F.array().cast("array<string>")
    x = squeezed(spark, sf).join(src.assets(spark, sf), "asset_id").join(heard, ["asset_id", "ts"], "left").withColumns({"sources": F.coalesce("sources", none), "events": F.coalesce("events", none)})
    there = lambda c: F.when(F.size(c) > 0, "available").otherwise("missing")
    volatility = core.volatility_bucket(F.lit(None).cast("string"), F.lit(None).cast("double"), (F.col("high") - F.col("low")) / F.col("close") / 50)
    return rounded(models.prediction_metrics(models.segments(x, {
        "sector": F.col("sector"), "liquidity_bucket": core.liquidity_bucket(F.col("close") * F.col("volume") * 200), "volatility_regime": volatility, "source_type": F.col("sources"),
        "source_availability": there("sources"), "event_type": F.col("events"), "event_availability": there("events")}).select("segment", "ts", "score", "y", "expected"), ["segment"], "ts", 5))


@query("A27_macro_f1", "WITH p AS (SELECT lang AS gold, CASE WHEN regexp_matches(text, '[ñíó]') THEN 'es' WHEN regexp_matches(text, '[éèê]') THEN 'fr' WHEN regexp_matches(text, '[äöüß]') THEN 'de' ELSE 'en' END AS predicted FROM documents), l AS (SELECT unnest(['en', 'de', 'fr', 'es']) AS label) SELECT label, round(coalesce(2.0 * count(*) FILTER (WHERE gold = label AND predicted = label) / nullif(count(*) FILTER (WHERE gold = label) + count(*) FILTER (WHERE predicted = label), 0), 0.0), 6)::DOUBLE AS f1 FROM l, p GROUP BY label")
def a27(spark, sf):
    t = F.col("text")
    p = F.when(t.rlike("[ñíó]"), "es").when(t.rlike("[éèê]"), "fr").when(t.rlike("[äöüß]"), "de").otherwise("en")
    return rounded(models.macro_f1(src.table(spark, sf, "documents").select(F.col("lang").alias("gold"), p.alias("predicted")), ["en", "de", "fr", "es"]))


LIM = portfolio.Limits()
MD = f"""md AS (SELECT l.asset_id, l.ts, close, close * volume AS dollar_volume, sector, close - open AS score, forward_return, 0.5 + (seq % 5) / 4.0::DOUBLE AS beta FROM labels l JOIN assets USING (asset_id) WHERE forward_return IS NOT NULL),
t0 AS (SELECT *, sign(score) * {LIM.max_position_weight} AS w0 FROM md WHERE score <> 0 QUALIFY row_number() OVER (PARTITION BY ts ORDER BY abs(score) DESC, asset_id) <= 6)"""


def candidates(spark, sf):
    l = market.forward_labels(src.bars(spark, sf), 1).where("forward_return is not null").join(src.assets(spark, sf), "asset_id")
    return l.select("asset_id", "ts", "close", (F.col("close") * F.col("volume")).alias("dollar_volume"), "sector", (F.col("close") - F.col("open")).alias("score"), "forward_return", (0.5 + (F.col("seq") % 5) / 4.0).alias("beta"))


@query("T02_top_k", f"WITH {src.ASSETS}, {src.BARS}, {LABELS}, {MD} SELECT ts, asset_id, w0::DOUBLE AS weight FROM t0")
def t02(spark, sf):
    return portfolio.top_k(candidates(spark, sf), 6, ["ts"], LIM).select("ts", "asset_id", "weight")


CHAIN = f"""t1 AS (SELECT *, w0 * CASE WHEN sum(abs(w0)) OVER (PARTITION BY ts, sector) > {LIM.max_sector_weight} THEN {LIM.max_sector_weight} / sum(abs(w0)) OVER (PARTITION BY ts, sector) ELSE 1.0::DOUBLE END AS w1 FROM t0),
t2 AS (SELECT *, w1 * CASE WHEN sum(abs(w1)) OVER (PARTITION BY ts) > {LIM.max_gross_exposure} THEN {LIM.max_gross_exposure} / sum(abs(w1)) OVER (PARTITION BY ts) ELSE 1.0 END AS w2 FROM t1),
t3a AS (SELECT *, sum(greatest(w2, 0.0)) OVER (PARTITION BY ts) AS lo, -sum(least(w2, 0.0)) OVER (PARTITION BY ts) AS sh FROM t2),
t3 AS (SELECT *, w2 * CASE WHEN w2 > 0 AND lo - sh > {LIM.max_net_exposure} THEN (sh + {LIM.max_net_exposure}) / lo WHEN w2 <= 0 AND lo - sh < -{LIM.max_net_exposure} THEN (lo + {LIM.max_net_exposure}) / sh ELSE 1.0 END AS w3 FROM t3a),
t4 AS (SELECT *, w3 * CASE WHEN abs(sum(w3 * beta) OVER (PARTITION BY ts)) > {LIM.max_beta_exposure} THEN {LIM.max_beta_exposure} / abs(sum(w3 * beta) OVER (PARTITION BY ts)) ELSE 1.0 END AS w4 FROM t3),
t5 AS (SELECT *, w4 * CASE WHEN sum(abs(w4)) OVER (PARTITION BY ts) > {LIM.max_daily_turnover} THEN {LIM.max_daily_turnover} / sum(abs(w4)) OVER (PARTITION BY ts) ELSE 1.0 END AS w5 FROM t4),
t6 AS (SELECT *, CASE WHEN abs(w5) * 1e6 / dollar_volume > {LIM.max_participation_rate} THEN sign(w5) * {LIM.max_participation_rate} * dollar_volume / 1e6 ELSE w5 END AS w6 FROM t5),
t7 AS (SELECT *, sum(abs(w6)) OVER (PARTITION BY ts) AS g, abs(sum(w6) OVER (PARTITION BY ts)) AS n, abs(sum(w6 * beta) OVER (PARTITION BY ts)) AS b, sum(abs(w6)) OVER (PARTITION BY ts, sector) AS x FROM t6),
book AS (SELECT *, w6 * least(1.0, {LIM.max_gross_exposure} / greatest(g, {LIM.max_gross_exposure}), {LIM.max_net_exposure} / greatest(n, {LIM.max_net_exposure}), {LIM.max_beta_exposure} / greatest(b, {LIM.max_beta_exposure}), {LIM.max_sector_weight} / greatest(max(x) OVER (PARTITION BY ts), {LIM.max_sector_weight})) AS weight FROM t7)"""


def book(spark, sf):
    return portfolio.constrain(portfolio.top_k(candidates(spark, sf), 6, ["ts"], LIM), ["ts"], LIM, 1e6)


@query("M07_constrained_weights", f"WITH {src.ASSETS}, {src.BARS}, {LABELS}, {MD}, {CHAIN} SELECT ts, asset_id, round(weight, 6) + 0.0::DOUBLE AS weight, round(abs(weight) * 1e6 / dollar_volume, 6) AS participation FROM book WHERE abs(weight) > 1e-12")
def m07(spark, sf):
    return rounded(book(spark, sf).select("ts", "asset_id", "weight", "participation"))


@query("A20_exposures", f"WITH {src.ASSETS}, {src.BARS}, {LABELS}, {MD}, {CHAIN} SELECT ts, round(sum(abs(weight)), 6) AS gross, round(sum(weight), 6) + 0.0::DOUBLE AS net, round(sum(weight * beta), 6) + 0.0::DOUBLE AS beta FROM book WHERE abs(weight) > 1e-12 GROUP BY ts")
def a20(spark, sf):
    return rounded(portfolio.exposures(book(spark, sf), ["ts"]).select("ts", "gross", "net", "beta"))


COSTS = CostModel()


def _cost_sql(w: str, borrow: bool) -> dict[str, str]:
    t = f"abs({w})"
    return {"commission": f"{t} * {COSTS.commission_bps} / 1e4", "spread": f"{t} * {COSTS.half_spread_bps} / 1e4",
            "slippage": f"{t} * ({COSTS.slippage_bps} + vol * 1e4 * {COSTS.volatility_slippage_multiplier} + part * {COSTS.participation_slippage_bps}) / 1e4",
            "market_impact": f"{t} * vol * sqrt(part) * {COSTS.market_impact_multiplier}", "borrow": f"abs(least(0.0, {w})) * {COSTS.borrow_bps_per_year} / 1e4 * 7.0 / 365.0" if borrow else "0.0"}


_IN, _OUT = _cost_sql("weight", True), _cost_sql("weight * (1 + fr)", False)
# Weekly returns of the adapter's bars are far from real ones, so they are damped by tanh before compounding.
PERIODS = f"""pb AS (SELECT ts, weight, 0.02::DOUBLE AS vol, abs(weight) * 1e6 / dollar_volume AS part, dollar_volume, (exp(2 * least(forward_return, 5) / 50) - 1) / (exp(2 * least(forward_return, 5) / 50) + 1) AS fr FROM book WHERE abs(weight) > 1e-12),
per AS (SELECT ts, sum(weight * fr) AS gross_return, {', '.join(f'sum({_IN[k]} + {_OUT[k]}) AS {k}_return' for k in _IN)}, sum(abs(weight)) AS gross_exposure, sum(weight) AS net_exposure,
  sum(abs(weight) + abs(weight * (1 + fr))) AS turnover, max(part) AS max_participation_rate, min(dollar_volume * 0.05 / abs(weight)) AS capacity_proxy_equity, count(*) AS trades FROM pb GROUP BY ts),
pp AS (SELECT *, commission_return + spread_return + slippage_return + market_impact_return + borrow_return AS cost_return, gross_return - (commission_return + spread_return + slippage_return + market_impact_return + borrow_return) AS net_return FROM per)"""


def period_rows(spark, sf):
    e = F.exp(2 * F.least(F.col("forward_return"), F.lit(5)) / 50)
    b = book(spark, sf).withColumns({"forward_return": (e - 1) / (e + 1), "volatility": F.lit(0.02), "holding_days": F.lit(7.0)})
    return portfolio.periods(b, ["ts"], COSTS)


PB = f"WITH {src.ASSETS}, {src.BARS}, {LABELS}, {MD}, {CHAIN}, {PERIODS}"


@query("M09_backtest_periods", f"{PB} SELECT ts, trades, {r('gross_return', 'net_return', 'cost_return', 'commission_return', 'spread_return', 'slippage_return', 'market_impact_return', 'borrow_return', 'gross_exposure', 'net_exposure', 'turnover', 'max_participation_rate')} FROM pp")
def m09(spark, sf):
    return rounded(period_rows(spark, sf).select("ts", "trades", "gross_return", "net_return", "cost_return", "commission_return", "spread_return", "slippage_return", "market_impact_return", "borrow_return",
                                                 "gross_exposure", "net_exposure", "turnover", "max_participation_rate"))


CURVE = "cv AS (SELECT *, exp(sum(ln(greatest(0.0, 1 + net_return))) OVER (ORDER BY ts)) AS equity FROM pp), dd AS (SELECT *, equity / greatest(1.0, max(equity) OVER (ORDER BY ts)) - 1 AS drawdown FROM cv)"


@query("W26_equity_curve", f"{PB}, {CURVE} SELECT ts, round(equity, 6) AS equity, round(drawdown, 6) + 0.0::DOUBLE AS drawdown FROM dd")
def w26(spark, sf):
    return rounded(portfolio.equity_curve(period_rows(spark, sf), "ts").select("ts", "equity", "drawdown"))


_TOTALS = ["commission", "spread", "slippage", "market_impact", "borrow"]


@query("A22_backtest_summary", f"""{PB}, {CURVE}, lo AS (SELECT *, row_number() OVER (ORDER BY net_return) <= greatest(1, floor(count(*) OVER () * 0.05)) AS low FROM dd), b AS (SELECT ts, sum(weight * beta) AS beta FROM book WHERE abs(weight) > 1e-12 GROUP BY ts)
SELECT count(*) AS periods, round(arg_max(equity, ts) - 1, 6) + 0.0::DOUBLE AS total_return, round(arg_max(equity, ts) - 1, 6) + 0.0::DOUBLE AS cost_adjusted_return, round(product(greatest(0.0, 1 + gross_return)) - 1, 6) + 0.0::DOUBLE AS gross_total_return,
  round(power(arg_max(equity, ts), 52.0 / count(*)) - 1, 6) + 0.0::DOUBLE AS annualized_return, round(avg(net_return) / stddev_pop(net_return) * sqrt(52.0), 5) + 0.0::DOUBLE AS sharpe, round(avg(net_return) / stddev_pop(least(0.0, net_return)) * sqrt(52.0), 5) + 0.0::DOUBLE AS sortino,
  round(stddev_pop(net_return) * sqrt(52.0), 6) AS annualized_volatility, round(min(drawdown), 6) + 0.0::DOUBLE AS max_drawdown, round(avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS hit_rate,
  round(avg(net_return) FILTER (WHERE low), 6) + 0.0::DOUBLE AS tail_loss_5pct, round(avg(turnover), 6) AS average_turnover, round(avg(cost_return), 6) AS average_cost_return, round(sum(cost_return), 6) AS total_cost_return, round(avg(gross_exposure), 6) AS average_gross_exposure,
  round(avg(net_exposure), 6) + 0.0::DOUBLE AS average_net_exposure, round(avg(b.beta), 6) + 0.0::DOUBLE AS average_beta_exposure, round(max(max_participation_rate), 6) AS max_participation_rate, round(coalesce(min(capacity_proxy_equity) FILTER (WHERE capacity_proxy_equity > 0), 0.0), 4) AS minimum_capacity_proxy_equity,
  7.0::DOUBLE AS average_holding_period_days, round(arg_max(equity, ts), 6) AS final_equity, sum(trades)::BIGINT AS trades, {', '.join(f'round(sum({x}_return), 6) AS total_{x}_return' for x in _TOTALS)} FROM lo JOIN b USING (ts)""")
def a22(spark, sf):
    s = portfolio.summary(period_rows(spark, sf), "ts").drop("mean_return")
    return rounded(s.withColumns({c: F.round(c, n) for c, n in (("sharpe", 5), ("sortino", 5), ("minimum_capacity_proxy_equity", 4))}))


@query("F16_eligibility", f"""WITH {src.ASSETS}, {src.BARS}, {LABELS}, {MD} SELECT ts, asset_id, coalesce(array_to_string(list_filter([CASE WHEN close < 1000 THEN 'min_price' END, CASE WHEN dollar_volume < 50000 THEN 'min_dollar_volume' END, CASE WHEN score < 0 AND asset_id <> 'N1' THEN 'short_unavailable' END], lambda x: x IS NOT NULL), ','), '') AS reasons FROM md""")
def f16(spark, sf):
    lim = portfolio.Limits(min_price=1000.0, min_dollar_volume=50000.0)
    c = candidates(spark, sf).withColumns({"weight": F.col("score"), "short_available": F.col("asset_id") == "N1", "hard_to_borrow": F.lit(False)})
    return portfolio.eligibility(c, lim).select("ts", "asset_id", F.array_join("reasons", ",").alias("reasons"))


CAPITAL = {"small": 1e4, "middle": 1e6, "large": 1e9}
RULES = accounts.Rules(LIM, COSTS)


def account_events(spark, sf):
    """Each decision as a round trip, once for each capital."""
    damped = F.tanh(F.least(F.col("forward_return"), F.lit(5.0)) / 50)  # as in period_rows
    leg = F.struct("asset_id", F.col("weight").alias("target"), F.col("close").cast("double").alias("price"), F.col("dollar_volume").cast("double").alias("dollar_volume"), "sector", F.col("beta").cast("double").alias("beta"), F.lit(0.02).alias("volatility"),
                   F.lit(True).alias("short_available"), F.lit(False).alias("hard_to_borrow"), damped.alias("forward_return"))
    legs = portfolio.top_k(candidates(spark, sf), 6, ["ts"], LIM).groupBy("ts").agg(F.array_sort(F.collect_list(leg)).alias("legs"))  # six a decision
    who = F.explode(F.array(*(F.struct(F.lit(k).alias("account"), F.lit(v).alias("capital")) for k, v in CAPITAL.items()))).alias("who")
    return legs.select(who, "ts", "legs").select("who.account", F.col("ts").cast("timestamp").alias("at"), F.lit(0).cast("bigint").alias("seq"), F.lit("round_trip").alias("kind"), F.lit(7.0).alias("holding_days"), "legs", "who.capital")


_ENTER, _LEAVE = ({k: e.replace("vol", "0.02") for k, e in _cost_sql(w, b).items()} for w, b in (("w", True), ("w * (1 + fr)", False)))
_LEFT = {k: e.replace("part", "out_part") for k, e in _LEAVE.items()}


@query("M09_equity_coupled_accounts", f"""WITH RECURSIVE {src.ASSETS}, {src.BARS}, {LABELS}, {MD.replace('t0 AS', 'ta AS')}, t0 AS (SELECT * FROM ta WHERE close >= {LIM.min_price} AND dollar_volume >= {LIM.min_dollar_volume}), {CHAIN.replace(str(LIM.max_daily_turnover), str(LIM.max_daily_turnover / 2.1))},
legs AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY ts) AS n, ts, sector, beta, dollar_volume, w5, (exp(2 * least(forward_return, 5) / 50) - 1) / (exp(2 * least(forward_return, 5) / 50) + 1) AS fr FROM t5),
s AS (SELECT unnest({list(CAPITAL)}) AS account, unnest({list(CAPITAL.values())})::DOUBLE AS equity, 0::BIGINT AS n, NULL::DATE AS ts, 0.0::DOUBLE AS gross_return, 0.0::DOUBLE AS cost_return, 0.0::DOUBLE AS turnover, 0.0::DOUBLE AS gross, 0.0::DOUBLE AS net, 0::BIGINT AS trades
  UNION ALL
  SELECT account, equity * greatest(0.0, 1 + sum(w * fr) - sum({' + '.join(_ENTER.values())} + {' + '.join(_LEFT.values())})), n, ts, sum(w * fr), sum({' + '.join(_ENTER.values())} + {' + '.join(_LEFT.values())}), sum(abs(w) + abs(w * (1 + fr))), sum(abs(w)), sum(w), 2 * count(*)
  FROM (SELECT *, abs(w) * equity / dollar_volume AS part, abs(w * (1 + fr)) * equity / dollar_volume AS out_part FROM (
    SELECT *, w6 * least(1.0, {LIM.max_gross_exposure} / greatest(g, {LIM.max_gross_exposure}), {LIM.max_net_exposure} / greatest(abs(nn), {LIM.max_net_exposure}), {LIM.max_beta_exposure} / greatest(abs(bb), {LIM.max_beta_exposure}), {LIM.max_sector_weight} / greatest(xx, {LIM.max_sector_weight})) AS w FROM (
      SELECT *, sum(abs(w6)) OVER (PARTITION BY account) AS g, sum(w6) OVER (PARTITION BY account) AS nn, sum(w6 * beta) OVER (PARTITION BY account) AS bb, max(x) OVER (PARTITION BY account) AS xx FROM (
        SELECT *, sum(abs(w6)) OVER (PARTITION BY account, sector) AS x FROM (
          SELECT s.account, s.equity, legs.*, sign(w5) * least(abs(w5), {LIM.max_participation_rate} / 1.1 * dollar_volume / s.equity) AS w6 FROM s JOIN legs ON legs.n = s.n + 1)))))
  GROUP BY account, equity, n, ts)
SELECT account, ts, 'ok' AS status, round(equity / list_extract(map_extract(MAP {{{', '.join(f"'{k}': {v}" for k, v in CAPITAL.items())}}}, account), 1), 6) AS equity, {r('gross_return', 'cost_return', 'turnover', 'gross', 'net')}, trades FROM s WHERE n > 0""")
def m09_accounts(spark, sf):
    """Limits and costs depend on what the account has earned: a billion is held back by participation, ten thousand are not."""
    o = accounts.replay(account_events(spark, sf), RULES)
    share = F.col("equity") / F.element_at(F.create_map(*(F.lit(x) for kv in CAPITAL.items() for x in kv)), F.col("account"))
    return rounded(o.select("account", F.to_date("at").alias("ts"), "status", share.alias("equity"), "gross_return", "cost_return", "turnover", "gross", "net", F.size("trades").cast("bigint").alias("trades")))


@query("M20_stateful_account")
def m20_stateful(spark, sf):
    """The same decisions as accounts that hold on: each week marked to its returns, then rebalanced from what is left to the next targets."""
    trips = account_events(spark, sf)
    leg = lambda x, **to: F.struct(*(to.get(c, x[c]).alias(c) for c in ("asset_id", "target", "price", "dollar_volume", "sector", "beta", "volatility", "short_available", "hard_to_borrow", "forward_return")))
    trade = trips.withColumn("kind", F.lit("rebalance"))
    mark = trips.withColumns({"kind": F.lit("mark"), "seq": F.lit(1).cast("bigint"), "legs": F.transform("legs", lambda x: leg(x, target=F.lit(None).cast("double")))})
    o = accounts.replay(trade.unionByName(mark), RULES)
    return rounded(o.select("account", "at", "seq", "kind", "status", "equity", "gross_return", "cost_return", "turnover", "gross", "net", "beta", F.size("trades").alias("trades")))


@query("P11_buckets", f"""WITH {src.BARS} SELECT asset_id, ts, CASE WHEN close * volume * 200 < 5e6 THEN 'low' WHEN close * volume * 200 < 5e7 THEN 'medium' ELSE 'high' END AS liquidity,
CASE seq % 3 WHEN 1 THEN 'calm' WHEN 0 THEN CASE WHEN close / open < 0.8 THEN 'low' WHEN close / open <= 1.2 THEN 'normal' ELSE 'high' END ELSE CASE WHEN (high - low) / close / 50 < 0.01 THEN 'low' WHEN (high - low) / close / 50 < 0.03 THEN 'normal' ELSE 'high' END END AS volatility FROM bars""")
def p11(spark, sf):
    label, ratio = F.when(F.col("seq") % 3 == 1, "calm"), F.when(F.col("seq") % 3 == 0, F.col("close") / F.col("open"))
    volatility = core.volatility_bucket(label, ratio, (F.col("high") - F.col("low")) / F.col("close") / 50)
    return src.bars(spark, sf).select("asset_id", "ts", core.liquidity_bucket(F.col("close") * F.col("volume") * 200).alias("liquidity"), volatility.alias("volatility"))


@query("C18_costs", "SELECT o_orderkey, round(t * 1.0 / 1e4, 15) AS commission, round(t * (1.0 + v * 500 + p * 50.0) / 1e4, 15) AS slippage, round(t * v * sqrt(p) * 0.1, 15) AS market_impact FROM (SELECT o_orderkey, o_totalprice / 1e6 AS t, (o_custkey % 10) / 100.0::DOUBLE AS v, (o_orderkey % 20) / 400.0::DOUBLE AS p FROM orders)")
def c18(spark, sf):
    o = src.table(spark, sf, "orders").withColumns({"t": F.col("o_totalprice") / 1e6, "v": (F.col("o_custkey") % 10) / 100.0, "p": (F.col("o_orderkey") % 20) / 400.0})
    c = COSTS.columns(F.col("t"), F.col("v"), F.col("p"), F.lit(0.0), F.lit(0.0))
    return rounded(o.select("o_orderkey", *(c[k].alias(k) for k in ("commission", "slippage", "market_impact"))), 15)


@query("M16_holm", """WITH p AS (SELECT s_suppkey AS k, least(1.0, abs(s_acctbal) / 200000.0) AS p FROM supplier), s AS (SELECT k, p, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, k) + 1) * p) AS x, row_number() OVER (ORDER BY p, k) AS i FROM p)
SELECT k, round(max(x) OVER (ORDER BY i), 6)::DOUBLE AS adjusted FROM s""")
def m16(spark, sf):
    p = src.table(spark, sf, "supplier").select(F.lit("all").alias("family"), F.col("s_suppkey").alias("k"), F.least(F.lit(1.0), F.abs("s_acctbal") / 200000.0).alias("p"))
    w = Window.partitionBy("family")
    x, i = holm(F.col("p"), w.orderBy("p", "k"), w)
    s = p.withColumns({"x": x, "i": i})
    return rounded(s.select("k", F.max("x").over(w.orderBy("i")).alias("adjusted")))


@query("M14_block_bootstrap")
def m14(spark, sf):
    return rounded(statistics.block_bootstrap(period_rows(spark, sf).select(F.lit("all").alias("family"), "ts", F.col("net_return").alias("value")), ["family"], "ts", 8, 500, 23))


@query("W28_seeded_shuffle")
def w28(spark, sf):
    return rounded(statistics.seeded_shuffle(candidates(spark, sf).select("ts", "asset_id", "score"), ["ts"], "asset_id", "score", 23))


@query("T03_selector_random_k", f"WITH {src.BARS}, s AS (SELECT ts, asset_id, row_number() OVER (PARTITION BY ts ORDER BY sha256('23:' || ts::VARCHAR || ':' || asset_id), asset_id) AS k FROM bars) SELECT ts, asset_id, k::INTEGER AS k FROM s WHERE k <= 4")
def t03(spark, sf):
    return models.select_top(src.bars(spark, sf), ["ts"], models.random_order(23, F.col("ts"), F.col("asset_id")), 4).select("ts", "asset_id", "k")


@query("T03_selector_momentum", f"WITH {src.BARS}, m AS (SELECT ts, asset_id, close / lag(close, 5) OVER (PARTITION BY asset_id ORDER BY ts) - 1 AS m FROM bars), s AS (SELECT ts, asset_id, row_number() OVER (PARTITION BY ts ORDER BY m DESC, asset_id) AS k FROM m WHERE m IS NOT NULL) SELECT ts, asset_id, k::INTEGER AS k FROM s WHERE k <= 4")
def t03b(spark, sf):
    m = src.bars(spark, sf).withColumn("m", F.col("close") / F.lag("close", 5).over(market.by_asset()) - 1)
    return models.select_top(m, ["ts"], -F.col("m"), 4).select("ts", "asset_id", "k")


@query("M09_sequential_replay")
def m09s(spark, sf):
    """Equity-coupled replay: participation limits depend on the equity so far."""
    damped = F.tanh(F.least(F.col("forward_return"), F.lit(5.0)) / 50)  # as in period_rows
    return rounded(statistics.replay(candidates(spark, sf).withColumns({"family": F.lit("base"), "forward_return": damped}), 6, LIM, COSTS, 1e6))
