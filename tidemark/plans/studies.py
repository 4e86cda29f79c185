"""Studies over the features, labels and portfolios, and single columns of the wider queries (W, A, X, M, G ids of the survey)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import core
from ..operators import audit, lineage, market, models, portfolio, textwindow
from ..sources import adapters as src
from .derived import flags
from .joins import DEC, FUND, SIG, decisions, fundamentals, signals
from .market import LABELS
from .models import BASE, CHAIN, FEATURES, LIM, LONG, MD, SCORED, SNAP, PRED, book, candidates, rows, scored
from .registry import ORACLES, QUERIES, query, r, rounded

t = src.table


def part(name: str, of: str, columns: list[str], where: str | None = None) -> None:
    """Registers columns of a wider query under the id of the operator that makes them; Catalyst prunes the rest."""
    whole, picked = QUERIES[of], ", ".join(columns)

    def run(spark, sf):
        df = whole(spark, sf)
        return (df.where(where) if where else df).select(*columns)

    query(name, f"SELECT {picked} FROM ({ORACLES[of]}) AS whole_" + (f" WHERE {where}" if where else ""))(run)


AT, DAY = ["asset_id", "ts"], ["asset_id", "asof_day"]
part("W02_reversal_momentum", "W01_returns", [*AT, "short_term_reversal_1d", "momentum_5d", "momentum_20d"])
part("W03_gap_intraday", "W04_liquidity", [*AT, "gap_return_1d", "gap_return_1d_missing", "intraday_return"])
part("W05_dollar_volume", "W04_liquidity", [*AT, "dollar_volume", "average_dollar_volume_20d"])
part("W06_amihud", "W04_liquidity", [*AT, "amihud_illiquidity_20d"])
part("W07_spread_estimate", "W04_liquidity", [*AT, "high_low_spread_estimate"])
part("W09_downside_volatility", "W08_volatility", [*AT, "downside_volatility_20d"])
part("W10_range_volatility", "W08_volatility", [*AT, "high_low_volatility_20d"])
part("W11_volatility_regime", "W08_volatility", [*AT, "volatility_regime"])
part("W13_market_residual", "W12_market_model", [*AT, "market_return_1d", "market_residual_return_1d"])
part("W14_sector_residual", "W12_market_model", [*AT, "sector_return_1d", "sector_residual_return_1d", "sector_data_missing"])
part("W15_size_history", "W04_liquidity", [*AT, "size_proxy_log_dollar_volume", "volume_history_count"])
part("W18_label_targets", "W17_forward_labels", [*AT, "forward_return", "binary_up", "missing_reason"])
part("W20_percent_rank", "W19_cross_section", [*AT, "rank_pct"])
part("A02_sector_returns", "A01_market_sector_returns", ["ts", "sector", "mean_return"], "sector <> 'ALL'")
part("A03_population_std", "A06_beta_correlation", ["asset_id", "std"])
part("A04_rms", "A06_beta_correlation", ["asset_id", "rms"])
part("A07_pearson", "A06_beta_correlation", ["asset_id", "n", "correlation"])
part("A25_tail_loss", "A22_backtest_summary", ["periods", "tail_loss_5pct"])
part("A23_max_drawdown", "A22_backtest_summary", ["periods", "max_drawdown"])
part("X03_attention", "X01_text_window_7d", [*DAY, "attention_unique_item_count", "mention_velocity", "attention_abnormal"])
part("X04_weighted_sentiment", "X01_text_window_7d", [*DAY, "sentiment_mean", "sentiment_relevance_weighted", "sentiment_conf_weighted", "sentiment_credibility_weighted", "sentiment_decay_weighted"])
part("X05_sentiment_shape", "X01_text_window_7d", [*DAY, "sentiment_max_positive", "sentiment_max_negative", "sentiment_dispersion", "sentiment_positive_negative_ratio", "sentiment_acceleration"])
part("X06_source_diversity", "X01_text_window_7d", [*DAY, "source_diversity_count", "unique_author_count"])
part("X07_credibility_decay", "X01_text_window_7d", [*DAY, "source_credibility_mean", "spam_score_mean", "text_decay_weight_sum"])
part("X08_event_counts", "X01_text_window_7d", [*DAY, "event_type_diversity", "event_f_count", "event_o_count", "event_p_count"])
part("A12_raw_diagnostics", "X01_text_window_7d", [*DAY, "raw_text_count", "raw_mention_velocity", "raw_attention_abnormal", "novelty_share", "duplicate_item_count"])
part("G04_metric_filter", "A19_segments", ["segment", "rows", "hit_rate", "pearson_ic"], "segment LIKE 'source_type: %'")

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_OWN = ", ".join(f"count(*) FILTER (WHERE source_type = '{s}')::DOUBLE AS attention_source_{s.lower()}_count, round(coalesce(avg(sentiment) FILTER (WHERE source_type = '{s}'), 0.0), 6) + 0.0::DOUBLE AS sentiment_source_{s.lower()}_mean" for s in SEGMENTS)


@query("X09_source_columns", f"""WITH {src.BARS}, {src.SIGNALS}, {SIG}, {DEC} SELECT d.asset_id, d.asof_day, {_OWN} FROM dec d
LEFT JOIN sig s ON s.asset_id = d.asset_id AND s.avail <= d.asof_day AND s.avail > d.asof_day - 20 AND novelty > 0.5 GROUP BY d.asset_id, d.asof_day""")
def x09(spark, sf):
    return rounded(textwindow.by_source(decisions(spark, sf), signals(spark, sf), 20, SEGMENTS))


@query("X11_half_life", f"WITH {src.BARS} SELECT asset_id, ts, 3.0::DOUBLE AS text_decay_half_life_days, round(power(2.0, -(seq % 10) / 3.0), 6) AS weight FROM bars")
def x11(spark, sf):
    half_life = F.lit(3.0)
    return rounded(src.bars(spark, sf).select("asset_id", "ts", half_life.alias("text_decay_half_life_days"), core.decay(F.col("seq") % 10, half_life).alias("weight")))


_EV = "ev AS (SELECT asset_id, avail FROM sig WHERE event_type = 'P' GROUP BY ALL)"


@query("W16_context", f"""WITH {src.BARS}, {src.SIGNALS}, {SIG}, {DEC}, {FUND}, {_EV}, b AS (SELECT d.*, f.avail AS fa, f.v FROM dec d ASOF LEFT JOIN fund f ON f.asset_id = d.asset_id AND f.avail <= d.asof_day),
c AS (SELECT b.*, e.avail - b.asof_day AS n FROM b ASOF LEFT JOIN ev e ON e.asset_id = b.asset_id AND e.avail > b.asof_day)
SELECT asset_id, asof_day, round(coalesce(v, 0.0), 2) AS fundamental_value, v IS NULL AS fundamental_missing, asof_day - fa AS fundamental_age_days, n AS event_proximity_days, n IS NULL AS event_missing, coalesce(n <= 2, FALSE) AS event_blackout FROM c""")
def w16(spark, sf):
    events = signals(spark, sf).where("event_type = 'P'").select("asset_id", "avail").distinct()
    return rounded(textwindow.context(decisions(spark, sf), fundamentals(spark, sf), events), 2)


@query("W21_average_ranks", f"""WITH {src.BARS}, s AS (SELECT asset_id, ts, floor(volume / 10) AS x FROM bars)
SELECT asset_id, ts, (rank() OVER (PARTITION BY ts ORDER BY x) - 1 + (count(*) OVER (PARTITION BY ts, x) - 1) / 2.0)::DOUBLE AS average_rank FROM s""")
def w21(spark, sf):
    s, w = src.bars(spark, sf).select("asset_id", "ts", F.floor(F.col("volume") / 10).alias("x")), Window.partitionBy("ts")
    return s.select("asset_id", "ts", core.average_rank(F.col("x"), w, w.orderBy("x"), Window.partitionBy("ts", "x")).cast("double").alias("average_rank"))


@query("A05_weighted_mean", f"WITH {src.SIGNALS} SELECT asset_id, round(CASE WHEN sum(confidence * relevance) > 0 THEN sum(sentiment * confidence * relevance) / sum(confidence * relevance) ELSE 0.0 END, 6) + 0.0::DOUBLE AS sentiment FROM signals GROUP BY asset_id")
def a05(spark, sf):
    return rounded(src.signals(spark, sf).groupBy("asset_id").agg(core.weighted_mean(F.col("sentiment"), F.col("confidence") * F.col("relevance")).alias("sentiment")))


@query("A10_distinct_counts", f"WITH {src.SIGNALS} SELECT asset_id, count(DISTINCT item_id) AS items, count(DISTINCT source_type) AS sources, count(DISTINCT author) AS authors, count(DISTINCT event_type) AS events FROM signals GROUP BY asset_id")
def a10(spark, sf):
    n = F.count_distinct
    return src.signals(spark, sf).groupBy("asset_id").agg(n("item_id").alias("items"), n("source_type").alias("sources"), n("author").alias("authors"), n("event_type").alias("events"))


@query("A15_family_fit", f"""WITH {BASE}, {LONG}, c AS (SELECT feature, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS s, coalesce(covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0), 0.0) AS k FROM long WHERE y IS NOT NULL GROUP BY feature)
SELECT feature, n, round(mean, 4) + 0.0::DOUBLE AS mean, round(CASE WHEN s > 0 THEN s ELSE 1.0 END, 4) AS scale, round(k / sum(abs(k)) OVER (), 4) + 0.0::DOUBLE AS weight FROM c""")
def a15(spark, sf):
    return rounded(models.fit(rows(spark, sf), FEATURES), 4)


@query("A24_annualized_return", f"SELECT periods, round(power(1 + total_return, 52.0 / periods) - 1, 4) + 0.0::DOUBLE AS annualized_return FROM ({ORACLES['A22_backtest_summary']}) AS s")
def a24(spark, sf):
    s = QUERIES["A22_backtest_summary"](spark, sf)
    return rounded(s.select("periods", portfolio.annualized(F.col("total_return"), F.col("periods"), 52.0).alias("annualized_return")), 4)


# Labelled documents as gold, and what a reader of lengths would say of them; every ninth answer is missing.
_GOLD = """gold AS (SELECT doc_id, lang, CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END AS stance, CASE WHEN toxic = 1 THEN 'alert' END AS event, [doc_id % 3, 4] AS supporting, [doc_id % 2] AS counter, doc_id % 4 AS horizon FROM documents JOIN labels USING (doc_id)),
said AS (SELECT doc_id, CASE WHEN n_chars < 300 THEN 'abstain' WHEN n_chars >= 1200 THEN 'positive' ELSE 'negative' END AS stance, CASE WHEN n_chars % 5 = 0 THEN 'alert' END AS event, [n_chars % 3, 4, 5] AS supporting, [n_chars % 2] AS counter, n_chars % 4 AS horizon, (n_chars % 101) / 100.0::DOUBLE AS confidence FROM documents WHERE doc_id % 9 <> 0)"""
_F1 = lambda n: f"""(SELECT avg(f) FROM (SELECT 2.0 * sum(t) / (sum(g) + sum(p)) AS f FROM (SELECT {n} AS label, 1 AS g, 0 AS p, ({n} = p_{n})::INTEGER AS t FROM x WHERE x.lang = l.lang UNION ALL SELECT p_{n}, 0, 1, 0 FROM x WHERE x.lang = l.lang) GROUP BY label))"""


@query("A28_annotation_quality", f"""WITH {_GOLD}, x AS (SELECT g.doc_id, lang, g.stance, coalesce(g.event, 'none') AS event, coalesce(s.stance, 'invalid') AS p_stance, CASE WHEN s.doc_id IS NULL THEN 'invalid' WHEN s.stance = 'abstain' THEN 'abstain' ELSE coalesce(s.event, 'none') END AS p_event,
  len(list_intersect(list_distinct(s.supporting), g.supporting)) AS ok, len(s.supporting) AS cited, len(list_intersect(list_distinct(s.counter), g.counter)) AS okc, len(s.counter) AS citedc, s.horizon = g.horizon AS hz, coalesce(confidence, 0.0) AS p, coalesce(s.stance = g.stance, FALSE)::INTEGER AS y, s.doc_id IS NULL AS invalid FROM gold g LEFT JOIN said s USING (doc_id)),
l AS (SELECT lang, count(*) AS entities, coalesce(sum(ok) / nullif(sum(cited), 0)::DOUBLE, 0.0) AS evidence_precision, coalesce(sum(okc) / nullif(sum(citedc), 0)::DOUBLE, 0.0) AS counterevidence_precision, avg(coalesce(hz, FALSE)::INTEGER) AS horizon_accuracy, avg((p_stance = 'abstain')::INTEGER) AS abstention_rate,
  avg(invalid::INTEGER) AS invalid_rate, avg(power(p - y, 2)) AS brier FROM x GROUP BY lang),
e AS (SELECT lang, sum(d) AS d FROM (SELECT lang, abs(sum(y) - sum(p)) AS d FROM x GROUP BY lang, least(9, floor(p * 10))) GROUP BY lang)
SELECT lang, entities, {r('evidence_precision', 'counterevidence_precision', 'horizon_accuracy', 'abstention_rate', 'invalid_rate', 'brier')}, round(d / entities, 6)::DOUBLE AS calibration_error, round({_F1('stance')}, 6)::DOUBLE AS stance_macro_f1, round({_F1('event')}, 6)::DOUBLE AS event_macro_f1 FROM l JOIN e USING (lang)""")
def a28(spark, sf):
    d = t(spark, sf, "documents")
    n, i = F.col("n_chars"), F.col("doc_id")
    gold = d.join(t(spark, sf, "labels"), "doc_id").select("doc_id", "lang", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("stance"), F.when(F.col("toxic") == 1, "alert").alias("event"),
                                                          F.array(i % 3, F.lit(4).cast("long")).alias("supporting"), F.array(i % 2).alias("counter"), (i % 4).alias("horizon"))
    said = d.where("doc_id % 9 <> 0").select("doc_id", F.when(n < 300, "abstain").when(n >= 1200, "positive").otherwise("negative").alias("stance"), F.when(n % 5 == 0, "alert").alias("event"),
                                             F.array((n % 3).cast("long"), F.lit(4).cast("long"), F.lit(5).cast("long")).alias("supporting"), F.array((n % 2).cast("long")).alias("counter"), (n % 4).cast("long").alias("horizon"), ((n % 101) / 100.0).alias("confidence"))
    return rounded(models.annotation_quality(gold, said, ["doc_id"], ["lang"]))


@query("A29_accuracy", "SELECT source, count(*) AS n, round(avg((contains(coalesce(text, ''), '!!') = (quality = 0))::INTEGER), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY source")
def a29(spark, sf):
    a = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    return rounded(models.accuracy(a, F.col("quality") == 0, F.coalesce("text", F.lit("")).contains("!!"), ["source"]))


@query("A32_subgroup_effects", f"""WITH {src.ASSETS}, {src.BARS}, {LABELS}, {MD}, x AS (SELECT 'sector' AS dimension, sector AS value, sign(score) * forward_return AS e FROM md UNION ALL SELECT 'size', CASE WHEN dollar_volume < 100000 THEN 'small' ELSE 'large' END, sign(score) * forward_return FROM md)
SELECT dimension, value, count(*) AS n, round(avg(e), 5) + 0.0::DOUBLE AS effect FROM x GROUP BY ALL""")
def a32(spark, sf):
    c = candidates(spark, sf)
    size = F.when(F.col("dollar_volume") < 100000, "small").otherwise("large")
    return rounded(models.subgroup_effects(c, {"sector": F.col("sector"), "size": size}, F.signum("score") * F.col("forward_return")), 5)


_KIND = "CASE WHEN starts_with(f, 'llm_') THEN 'llm' WHEN regexp_matches(f, '^(text|sentiment|attention|event|source|novelty|mention|spam)_') THEN 'text' ELSE 'traditional' END"
_PRICES, _TEXTS = [f"return_{k}d" for k in (1, 3, 5, 20, 60)] + ["momentum_20d"], ["text_count", "attention_abnormal", "sentiment_mean", "event_f_count", "mention_velocity"]
_FILLED = " UNION ALL ".join(f"SELECT '{f}' AS f, count(*) FILTER (WHERE {f} <> 0) AS n FROM {table}" for table, names in (("price", _PRICES), ("words", _TEXTS)) for f in names)


def filled_features(spark, sf):
    """f, n: the features of prices and texts, and in how many rows each is not 0."""
    count = lambda of, names: QUERIES[of](spark, sf).agg(*(F.count_if(F.col(f) != 0).alias(f) for f in names)).select(F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("n")) for f in names))).alias("x")).select("x.*")
    return count("W01_returns", _PRICES).unionByName(count("X01_text_window_7d", _TEXTS))


@query("M02_feature_families", f"""WITH price AS ({ORACLES['W01_returns']}), words AS ({ORACLES['X01_text_window_7d']}), x AS ({_FILLED}), k AS (SELECT f, n, {_KIND} AS kind FROM x), m AS (SELECT unnest(['traditional', 'text', 'llm', 'combined', 'traditional_llm', 'all']) AS family)
SELECT family, f AS feature, n FROM m, k WHERE family IN (kind, 'all') OR (family = 'combined' AND kind <> 'llm') OR (family = 'traditional_llm' AND kind <> 'text')""")
def m02(spark, sf):
    named = spark.createDataFrame([(n, f) for n, fs in models.families(_PRICES + _TEXTS).items() for f in fs], "family string, f string")
    return named.join(filled_features(spark, sf), "f").select("family", F.col("f").alias("feature"), "n")


@query("G05_feature_catalog", f"WITH price AS ({ORACLES['W01_returns']}), words AS ({ORACLES['X01_text_window_7d']}), x AS ({_FILLED}) SELECT f AS feature, n FROM x WHERE {_KIND} = 'text'")
def g05(spark, sf):
    return m02(spark, sf).where("family = 'text'").select("feature", "n")


@query("M05_evaluation", f"""WITH {BASE}, {LONG}, {SNAP}, {PRED}, {SCORED}, h AS (SELECT *, CASE WHEN dense_rank() OVER (ORDER BY ts DESC) <= 20 THEN 'holdout' ELSE 'development' END AS segment FROM scored),
d AS (SELECT segment, ts, count(*) AS n, coalesce(covar_pop(score, y) / nullif(sqrt(var_pop(score) * var_pop(y)), 0), 0.0) AS ic, count(*) FILTER (WHERE score * y > 0) AS hits, sum(power(score - y, 2)) AS e FROM h GROUP BY ALL)
SELECT segment, sum(n)::BIGINT AS "rows", count(*) AS dates, round(avg(ic), 4) + 0.0::DOUBLE AS mean_ic, round(sum(hits) / sum(n), 4) AS hit_rate, round(sum(e) / sum(n), 4) AS mse FROM d GROUP BY segment""")
def m05(spark, sf):
    s = scored(spark, sf)
    last = s.select("ts").distinct().orderBy(F.desc("ts")).limit(20).withColumn("_h", F.lit("holdout"))  # the last 20 decisions are the holdout
    s = s.join(last, "ts", "left").withColumn("segment", F.coalesce("_h", F.lit("development")))
    return rounded(models.evaluate(s, "segment", "ts"), 4)


@query("M08_entry_budget", f"""WITH {src.ASSETS}, {src.BARS}, {LABELS}, {MD}, {CHAIN}, e AS (SELECT ts, sum(abs(weight)) AS turnover, max(abs(weight) * 1e6 / dollar_volume) AS participation FROM book WHERE abs(weight) > 1e-12 GROUP BY ts)
SELECT ts, round(turnover, 6) AS turnover, round(participation, 6) AS participation, turnover <= {LIM.max_daily_turnover} / 2.25 + 1e-9 AND participation <= {LIM.max_participation_rate} / 1.25 + 1e-9 AS round_trip, turnover <= {LIM.max_daily_turnover} + 1e-9 AND participation <= {LIM.max_participation_rate} + 1e-9 AS entry FROM e""")
def m08(spark, sf):
    """Which decisions leave room for their exit within the same session, and which for the entry alone."""
    e = book(spark, sf).groupBy("ts").agg(F.sum(F.abs("weight")).alias("turnover"), F.max("participation").alias("participation"))
    fits = lambda b: (F.col("turnover") <= b["max_daily_turnover"] + 1e-9) & (F.col("participation") <= b["max_participation_rate"] + 1e-9)
    return rounded(e.withColumns({"round_trip": fits(portfolio.entry_budget(LIM)), "entry": fits(portfolio.entry_budget(LIM, False))}))


@query("M17_selector_matrix", f"""WITH {src.ASSETS}, {src.BARS}, {LABELS}, {MD}, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, asset_id) AS a, row_number() OVER (PARTITION BY ts ORDER BY beta, asset_id) AS b FROM md),
x AS (SELECT 'full' AS selector, * FROM k UNION ALL SELECT 'top_score', * FROM k WHERE a <= 5 UNION ALL SELECT 'low_beta', * FROM k WHERE b <= 5),
p AS (SELECT selector, family, ts, avg(CASE family WHEN 'equal_weight' THEN 1.0 ELSE sign(score) END * forward_return) AS v FROM x, (SELECT unnest(['equal_weight', 'sign']) AS family) GROUP BY ALL)
SELECT selector, family, count(*) AS periods, round(avg(v), 5) + 0.0::DOUBLE AS mean_return FROM p GROUP BY ALL""")
def m17(spark, sf):
    own = Window.partitionBy("ts")
    k = candidates(spark, sf).withColumns({"a": F.row_number().over(own.orderBy(F.desc("score"), "asset_id")), "b": F.row_number().over(own.orderBy("beta", "asset_id"))})
    chosen = core.rule_flags(("full", F.lit(True)), ("top_score", F.col("a") <= 5), ("low_beta", F.col("b") <= 5))
    family = F.array(F.struct(F.lit("equal_weight").alias("family"), F.lit(1.0).alias("w")), F.struct(F.lit("sign").alias("family"), F.signum("score").alias("w")))
    x = k.select("ts", "score", "forward_return", F.explode(chosen).alias("selector"), family.alias("f")).select("ts", "selector", "forward_return", F.explode("f").alias("f"))
    p = x.groupBy("selector", "f.family", "ts").agg(F.avg(F.col("f.w") * F.col("forward_return")).alias("v"))
    return rounded(p.groupBy("selector", "family").agg(F.count(F.lit(1)).alias("periods"), F.avg("v").alias("mean_return")), 5)


_CUT = "(DATE '1998-01-05' - DATE '1970-01-01')"


@query("M24_frozen_holdout", f"""WITH {BASE}, {LONG}, {SNAP}, z AS (SELECT * FROM snap WHERE decision = (SELECT max(decision) FROM snap WHERE decision <= {_CUT}))
SELECT asset_id, ts, round(sum((x - mean) / scale * weight), 4) + 0.0::DOUBLE AS score FROM long JOIN z USING (feature) WHERE long.decision > {_CUT} GROUP BY ALL""")
def m24(spark, sf):
    x = rows(spark, sf)
    return rounded(models.frozen(x, models.walk_forward(x, FEATURES), 10231, FEATURES, ["asset_id", "ts"]), 4)


# A record for each order, which breaks any of the statements, several at once: the i-th where this holds.
_breaks = lambda i: f"(o_orderkey * {2 * i + 3} + {i}) % 7 = 0"
_STATEMENTS = ["registry_state_revealed", "reservation_precedes_result", "global_holdout_use_recorded", "frozen_model_unchanged", "candidate_lineage_exact", "execution_contracts_unchanged", "required_baselines_present", "holdout_result_artifact_hashes_bound",
               "holdout_pipeline_run_bound", "development_pipeline_run_bound", "all_attempts_retained", "holdout_contract_exact", "development_reserved_result_absent", "analyst_holdout_result_unreachable", "holdout_manifest_file_hash_bound"]


def holdout_records(spark, sf):
    k = F.col("o_orderkey")
    at = lambda name, broken, sound: F.when(F.expr(_breaks(_STATEMENTS.index(name))), broken).otherwise(sound)
    x, y = F.lit("x"), F.lit("y")
    names = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    run = lambda p, stage, name: {
        f"{p}_final_hash": x, f"{p}_bound_hash": x, f"{p}_id": x, f"{p}_bound_id": x, f"{p}_status": F.lit("complete"), f"{p}_stage": F.lit(stage), f"{p}_config": x, f"{p}_bound_config": x,
        f"{p}_artifacts": F.create_map(F.lit("a"), x, F.lit("b"), y), f"{p}_found": F.create_map(F.lit("b"), at(name, x, y), F.lit("a"), x)}
    use = F.struct(F.lit("reveal_reservation").alias("source"), x.alias("event"))
    attempt = lambda outcome, artifact: F.struct(F.lit("completed").alias("status"), F.lit(outcome).alias("outcome"), artifact.cast("string").alias("artifact"))
    identity = F.concat_ws("|", F.col("o_custkey").cast("string"), F.col("o_orderdate").cast("string"))
    return t(spark, sf, "orders").select(k, *(c.alias(n) for n, c in {
        "state": at("registry_state_revealed", "holdout_reserved", "holdout_revealed"), "reservation_seq": at("reservation_precedes_result", 9, 3), "revealed_seq": F.lit(5), "reservation_event": x, "uses": at("global_holdout_use_recorded", F.array(use, use), F.array(use)),
        "training_updates": F.lit(0), "model_before": x, "model_after": at("frozen_model_unchanged", "y", "x"), "model_now": x, "candidate": x, "frozen_candidate": at("candidate_lineage_exact", None, "x"), "manifest": y, "frozen_manifest": y,
        "definition": x, "compiled_definition": x, "frozen_definition": x, "evaluation": x, "frozen_evaluation": x, "costs": x, "compiled_costs": at("execution_contracts_unchanged", "y", "x"), "constraints": x, "compiled_constraints": x,
        "required_families": names("a", "b"), "families": at("required_baselines_present", names("b", "c"), names("c", "b", "a")), "bound_artifacts": F.create_map(F.lit("m"), x), "found_artifacts": F.create_map(F.lit("m"), at("holdout_result_artifact_hashes_bound", "y", "x")),
        **run("run", "holdout_evaluation", "holdout_pipeline_run_bound"), **run("dev", "backtest", "development_pipeline_run_bound"),
        "attempts": F.array(attempt("proposal", at("all_attempts_retained", None, "x")), attempt("abstention", F.lit(None))), "attempt_count": F.lit(2), "attempts_hash": x, "attempts_now": x,
        "identity": identity, "frozen_identity": identity, "study_identity": at("holdout_contract_exact", "other", identity), "development_keys": at("development_reserved_result_absent", names("ok", "holdout"), names("ok")), "forbidden_keys": names("holdout"),
        "analyst_texts": F.array(F.lit("plain"), at("analyst_holdout_result_unreachable", "see id-77 there", "nothing")), "secrets": names("id-77"), "revealed_manifest": y, "manifest_file": at("holdout_manifest_file_hash_bound", "x", "y")}.items()))


@query("G14_holdout_audit", f"SELECT o_orderkey, {flags(*((n, _breaks(i)) for i, n in enumerate(_STATEMENTS)))} AS findings FROM orders")
def g14(spark, sf):
    return audit.holdout_audit(holdout_records(spark, sf)).select("o_orderkey", F.array_join("findings", ",").alias("findings"))


_CHECKED = ["study_development_open", "input_identities_match", "tool_results_exact", "rounds_chained", "terminal_artifact_hash_bound", "content_hash_recomputes", "forbidden_content_absent", "evidence_citations_valid", "evidence_roles_disjoint", "counterevidence_challenged",
            "quantitative_claims_bound", "study_scope_matches", "required_inputs_catalogued", "template_permitted", "parameters_in_frozen_space", "required_controls_retained", "limitations_and_failure_conditions_present", "point_in_time_reentry_required",
            "abstention_queries_attempted", "abstention_missing_inputs_consistent"]


def proposal_records(spark, sf):
    k = F.col("o_orderkey")
    at = lambda name, broken, sound: F.when(F.expr(_breaks(_CHECKED.index(name))), broken).otherwise(sound)
    names = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    abstains = k % 5 == 0
    h, first = F.sha2(k.cast("string"), 256), F.repeat(F.lit("0"), F.lit(64))
    turn = lambda step, previous, i: F.struct(F.lit(step).alias("step"), previous.alias("previous"), i.alias("id"))
    claim = lambda v, ref: F.struct(F.lit(v).alias("value"), F.lit(ref).alias("reference"))
    bounds = lambda lo, hi: F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high"))
    return t(spark, sf, "orders").select(k, *(c.alias(n) for n, c in {
        "kind": F.when(abstains, "abstention").otherwise("proposal"), "attempt_status": at("study_development_open", "completed", "reserved"), "ids": names("s", "a", "b"), "expected": at("input_identities_match", names("s", "b", "a"), names("s", "a", "b")),
        "tool_results": names("t1", "t2"), "round_results": at("tool_results_exact", names("t2"), names("t2", "t1")), "rounds": F.array(turn(1, first, F.lit("r1")), turn(2, at("rounds_chained", "r0", "r1"), F.lit("r2"))), "artifact_hash": at("terminal_artifact_hash_bound", "abc", h),
        "content_hash": h, "recomputed_hash": at("content_hash_recomputes", first, h), "texts": F.array(F.lit("a plan"), at("forbidden_content_absent", "DROP Table now", "fine")), "forbidden": names("drop table", "http://"),
        "retrieved": names("e1", "e2", "e3"), "citations": at("evidence_citations_valid", names("e1", "e9"), names("e1")), "counter_citations": at("evidence_roles_disjoint", names("e1", "e2"), names("e2")), "queries": names("q1", "q2"),
        "searches": F.when(abstains, at("abstention_queries_attempted", names("q9"), names("q1"))).otherwise(at("counterevidence_challenged", names(), names("q1"))), "claims": F.array(claim(0.5, "m1"), claim(2.0, "m2")),
        "references": F.create_map(F.lit("m1"), F.lit(0.5), F.lit("m2"), at("quantitative_claims_bound", 2.5, 2.0)), "scope": names("h5", "ret"), "study_scope": at("study_scope_matches", names("h1", "ret"), names("h5", "ret")), "inputs": at("required_inputs_catalogued", names("i7"), names("i1")),
        "catalogue": names("i1", "i2"), "template": at("template_permitted", "free", "linear"), "templates": names("linear", "rank"), "parameters": F.create_map(F.lit("k"), at("parameters_in_frozen_space", 99.0, 5.0)), "space": F.create_map(F.lit("k"), bounds(1.0, 10.0)),
        "controls": at("required_controls_retained", names("c2"), names("c1", "c2")), "required_controls": names("c1"), "conditions": F.array(names("a"), at("limitations_and_failure_conditions_present", names(), names("b"))),
        "latest_available": at("point_in_time_reentry_required", 11, 9), "cutoff": F.lit(10), "reason": F.lit("missing_input"), "missing_inputs": at("abstention_missing_inputs_consistent", names("i1"), names("i8"))}.items()))


@query("G12_verification", f"SELECT o_orderkey, {flags(*((n, f'({_breaks(i)}) AND o_orderkey % 5 ' + ('>= 0' if i < 7 else '<> 0' if i < 18 else '= 0')) for i, n in enumerate(_CHECKED)))} AS failed FROM orders")
def g12(spark, sf):
    return audit.proposal_checks(proposal_records(spark, sf)).select("o_orderkey", F.array_join("failed", ",").alias("failed"))


_BIND = (("no_request", "role = 'assistant' AND coalesce(previous, 'none') <> 'user'"), ("empty_answer", "role = 'assistant' AND length(trim(coalesce(text, ''))) = 0"), ("repeats_request", "text = previous_text"))


@query("G22_round_binding", f"""WITH c AS (SELECT *, lag(role) OVER w AS previous, lag(text) OVER w AS previous_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) SELECT conv_id, turn, role, {flags(*_BIND)} AS broken FROM c""")
def g22(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = t(spark, sf, "conversations").withColumns({"previous": F.lag("role").over(w), "previous_text": F.lag("text").over(w)})
    return c.select("conv_id", "turn", "role", F.array_join(core.rule_flags(*((n, F.expr(x)) for n, x in _BIND)), ",").alias("broken"))


@query("S18_model_registry", f"WITH {BASE}, {LONG}, {SNAP} SELECT decision, feature, round(weight, 4) + 0.0::DOUBLE AS weight FROM snap")
def s18(spark, sf):
    """Snapshots saved under a version and read back."""
    from ..sources import stores
    from .derived import _folder

    at = _folder(spark)
    stores.save_model(models.walk_forward(rows(spark, sf), FEATURES), at, "v 1")
    return rounded(stores.load_model(spark, at, "v 1").select("decision", "feature", "weight"), 4)


# A log of each order's study: proposed, compiled, approved, started, completed, frozen, some of which are late, missing, twice there or not what they should be.
_K = "o_orderkey"
_EVENTS = {"event_hash": f"'e' || {_K} || ':' || i", "study": f"{_K} % 5000", "seq": f"{_K} * 10 + CASE WHEN i = 2 AND {_K} % 11 = 0 THEN 8 WHEN i = 6 THEN 4 ELSE i END", "kind": "CASE i WHEN 0 THEN 'proposed' WHEN 1 THEN 'compiled' WHEN 2 THEN 'approved' WHEN 3 THEN 'started' WHEN 5 THEN 'frozen' ELSE 'completed' END",
           "actor": f"CASE WHEN i = 5 AND {_K} % 7 = 0 THEN 'agent' WHEN i IN (2, 5) THEN 'human' ELSE 'system' END", "proposal": f"CASE WHEN i IN (0, 1, 5) THEN 'p' || {_K} END", "definition": f"CASE WHEN i IN (1, 2, 3, 5) THEN 'd' || {_K} || CASE WHEN i = 3 AND {_K} % 13 = 0 THEN 'x' ELSE '' END END",
           "run": f"CASE WHEN i IN (3, 4, 6) THEN 'r' || {_K} END", "result": f"CASE WHEN i IN (4, 5, 6) THEN 's' || {_K} END", "model": f"CASE WHEN i IN (4, 5, 6) THEN 'm' || {_K} END", "approval": f"CASE WHEN i = 5 THEN 'e' || ({_K} + CASE WHEN {_K} % 19 = 0 THEN 1 ELSE 0 END) || ':2' END",
           "parent": f"CASE WHEN i > 0 THEN 'e' || {_K} || ':' || CASE i WHEN 6 THEN 3 ELSE i - 1 END END"}
_THERE = f"(i <> 6 OR {_K} % 17 = 0) AND (i <> 0 OR {_K} % 23 <> 0) AND (i <> 3 OR {_K} % 29 <> 0)"
_LOG = f"ev AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _EVENTS.items())} FROM orders, (SELECT unnest(range(7)) AS i) WHERE {_THERE})"


def study_log(spark, sf):
    i = t(spark, sf, "orders").select(_K, F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i")).where(_THERE)
    return i.select(*(F.expr(e).alias(n) for n, e in _EVENTS.items()))


@query("G19_lineage_roots", f"""WITH RECURSIVE {_LOG}, up AS (SELECT event_hash, event_hash AS root, 0::BIGINT AS depth, parent FROM ev UNION ALL SELECT up.event_hash, p.event_hash, depth + 1, p.parent FROM up JOIN ev p ON p.event_hash = up.parent)
SELECT event_hash, arg_max(root, depth) AS root, max(depth) AS depth, CASE WHEN arg_max(coalesce(parent, ''), depth) = '' THEN 'complete' ELSE 'broken' END AS status FROM up GROUP BY event_hash""")
def g19_roots(spark, sf):
    return lineage.roots(study_log(spark, sf), "event_hash", "parent")


_N = lambda kind, on: f"(SELECT count(*) FROM ev x WHERE x.kind = '{kind}' AND x.study = f.study AND x.seq < f.seq AND {on})"
_RUN = "x.result = f.result AND x.model = f.model"


@query("G19_freeze_violations", f"""WITH {_LOG}, f AS (SELECT * FROM ev WHERE kind = 'frozen'),
c AS (SELECT f.event_hash, f.actor, {_N('proposed', 'x.proposal = f.proposal')} AS np, {_N('compiled', 'x.proposal = f.proposal AND x.definition = f.definition')} AS nc, {_N('approved', "x.event_hash = f.approval AND x.definition = f.definition AND x.actor = 'human'")} AS na, {_N('completed', _RUN)} AS nd,
  (SELECT count(*) FROM ev x JOIN ev s ON s.kind = 'started' AND s.study = x.study AND s.run = x.run AND s.seq < x.seq WHERE x.kind = 'completed' AND x.study = f.study AND x.seq < f.seq AND {_RUN}) AS ns,
  (SELECT count(*) FROM ev x JOIN ev s ON s.kind = 'started' AND s.study = x.study AND s.run = x.run AND s.seq < x.seq AND s.definition = f.definition WHERE x.kind = 'completed' AND x.study = f.study AND x.seq < f.seq AND {_RUN}) AS nm FROM f)
SELECT event_hash, unnest(list_filter([CASE WHEN actor <> 'human' THEN 'actor' END, CASE WHEN np = 0 THEN 'proposal' END, CASE WHEN nc = 0 THEN 'compile' END, CASE WHEN na = 0 THEN 'approval' END, CASE WHEN nd <> 1 THEN 'completion' END, CASE WHEN nd = 1 AND ns <> 1 THEN 'start' END, CASE WHEN ns = 1 AND nm = 0 THEN 'definition' END], lambda r: r IS NOT NULL)) AS rule FROM c""")
def g19_violations(spark, sf):
    return lineage.freeze_violations(study_log(spark, sf))
