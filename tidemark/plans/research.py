"""Paper trading, robustness, comparisons, annotation aggregates and verification (M18-M21, X10, A31, G12, S12, F19-F21 ids)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import core
from ..functions.text import LEGAL_SUFFIXES, name_aliases
from ..operators import market, models, paper, portfolio, quality, statistics, textwindow
from ..sources import adapters as src
from ..sources import stores
from .market import LABELS
from .models import CHAIN, COSTS, LIM, MD, PERIODS, _cost_sql, book, candidates
from .registry import query, rounded

t = src.table
FILLS = "fills AS (SELECT o_custkey AS account, l_partkey AS asset, o_orderkey, l_linenumber, l_suppkey, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity, l_extendedprice / l_quantity AS price, o_orderdate::DATE AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def fills(spark, sf):
    l, o = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("account"), F.col("l_partkey").alias("asset"), "o_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("o_orderdate").cast("date").alias("d"))


@query("M20_paper_snapshot", f"WITH {FILLS}, h AS (SELECT account, asset, sum(quantity) AS q, arg_max(price, (d, o_orderkey, l_linenumber, l_suppkey, price)) AS p, sum(quantity * price) AS paid FROM fills GROUP BY ALL) SELECT account, round(1e6 - sum(paid), 4) + 0.0::DOUBLE AS cash, round(sum(q * p), 4) + 0.0::DOUBLE AS market_value, count(*) FILTER (WHERE abs(q) > 1e-12) AS open_positions, round(1e6 - sum(paid) + sum(q * p), 4) + 0.0::DOUBLE AS equity FROM h GROUP BY account")
def m20(spark, sf):
    return rounded(paper.snapshot(fills(spark, sf), "account", "asset", ["d", "o_orderkey", "l_linenumber", "l_suppkey", "price"], 1e6), 4)


@query("M20_paper_positions", f"WITH {FILLS}, f AS (SELECT account, d, sum(quantity) AS quantity FROM fills GROUP BY ALL) SELECT account, d, round(sum(quantity) OVER (PARTITION BY account ORDER BY d), 6)::DOUBLE AS position FROM f")
def m20b(spark, sf):
    f = fills(spark, sf).groupBy("account", "d").agg(F.sum("quantity").alias("quantity"))
    return rounded(paper.positions(f, ["account"], ["d"]).select("account", "d", F.col("position").cast("double").alias("position")))


_MOVE = {k: e for k, e in _cost_sql("d", False).items() if k != "borrow"}


@query("M20_paper_account", f"""WITH {src.ASSETS}, {src.BARS}, {LABELS}, {MD}, {CHAIN}, {PERIODS}, b AS (SELECT ts, asset_id, weight, (exp(2 * least(forward_return, 5) / 50) - 1) / (exp(2 * least(forward_return, 5) / 50) + 1) AS fr, abs(weight) * 1e6 / dollar_volume AS part FROM book WHERE abs(weight) > 1e-12),
o AS (SELECT ts, row_number() OVER (ORDER BY ts) AS n FROM (SELECT DISTINCT ts FROM b)), w AS (SELECT b.*, n FROM b JOIN o USING (ts)), g AS (SELECT n, sum(weight * fr) AS gross FROM w GROUP BY n),
h AS (SELECT w.n + 1 AS n, asset_id, weight * (1 + fr) / (1 + gross) AS held FROM w JOIN g USING (n)), m AS (SELECT n, coalesce(weight, 0) - coalesce(held, 0) AS d, CASE WHEN weight IS NULL THEN 0.0::DOUBLE ELSE 0.02 END AS vol, coalesce(part, 0.0) AS part FROM w FULL JOIN h USING (n, asset_id)),
tr AS (SELECT o.ts, o.n, count(*) FILTER (WHERE abs(d) > 1e-12) AS trades, sum(abs(d)) AS turnover, sum({' + '.join(_MOVE.values())}) AS cost_return FROM m JOIN o USING (n) GROUP BY ALL)
SELECT ts, trades, round(turnover, 6) AS turnover, round(cost_return, 9) AS cost_return, round(gross, 6) + 0.0::DOUBLE AS gross_return, round(1e6 * exp(sum(ln((1 - cost_return) * (1 + gross))) OVER (ORDER BY ts)), 2) AS equity FROM tr JOIN g USING (n)""")
def m20c(spark, sf):
    e = F.exp(2 * F.least(F.col("forward_return"), F.lit(5)) / 50)
    b = book(spark, sf).withColumns({"forward_return": (e - 1) / (e + 1), "volatility": F.lit(0.02)})
    a = paper.simulate(b, "ts", COSTS, 1e6)
    return a.select("ts", "trades", F.round("turnover", 6).alias("turnover"), F.round("cost_return", 9).alias("cost_return"), (F.round("gross_return", 6) + F.lit(0.0)).alias("gross_return"), F.round("equity", 2).alias("equity"))


@query("M21_latest_intents", f"WITH {src.ASSETS}, {src.BARS}, {LABELS}, {MD}, {CHAIN} SELECT asset_id, ts, CASE WHEN weight > 0 THEN 'buy' ELSE 'sell' END AS side, round(weight, 6) + 0.0::DOUBLE AS target_weight, round(abs(weight) * 1e6, 2) AS notional, (SELECT min(ts) FROM bars WHERE ts > (SELECT max(ts) FROM book WHERE abs(weight) > 1e-12)) AS next_open FROM book WHERE abs(weight) > 1e-12 AND ts = (SELECT max(ts) FROM book WHERE abs(weight) > 1e-12)")
def m21(spark, sf):
    i = paper.intents(book(spark, sf), "ts", "weight", 1e6, src.bars(spark, sf).select("ts"))
    return rounded(i.withColumn("notional", F.round("notional", 2)))


_ALL = lambda sql: sql.replace("PARTITION BY ts", "PARTITION BY scenario, ts").replace("GROUP BY ts", "GROUP BY scenario, ts").replace("SELECT ts, ", "SELECT scenario, ts, ")
_SC = f"""WITH {src.ASSETS}, {src.BARS}, {LABELS}, md AS (SELECT l.asset_id, l.ts, close, close * volume AS dollar_volume, sector, close - open AS score, forward_return, 0.5 + (seq % 5) / 4.0::DOUBLE AS beta FROM labels l JOIN assets USING (asset_id) WHERE forward_return IS NOT NULL),
s0 AS (SELECT *, lag(score, 2) OVER (PARTITION BY asset_id ORDER BY ts) AS late FROM md), k AS (SELECT ts, row_number() OVER (ORDER BY ts) AS a, row_number() OVER (ORDER BY ts DESC) AS z FROM (SELECT DISTINCT ts FROM s0)),
sc AS (SELECT 'baseline' AS scenario, s0.* FROM s0 UNION ALL SELECT 'endpoint_shift_early', s0.* FROM s0 JOIN k USING (ts) WHERE z > 5 UNION ALL SELECT 'endpoint_shift_late', s0.* FROM s0 JOIN k USING (ts) WHERE a > 5
  UNION ALL SELECT 'causal_delay', s0.* REPLACE (late AS score) FROM s0 WHERE late IS NOT NULL UNION ALL SELECT 'source_ablation:volume', s0.* REPLACE (score * beta AS score) FROM s0),
t0 AS (SELECT *, sign(score) * {LIM.max_position_weight} AS w0 FROM sc WHERE score <> 0 QUALIFY row_number() OVER (PARTITION BY scenario, ts ORDER BY abs(score) DESC, asset_id) <= 3), {_ALL(CHAIN)}, {_ALL(PERIODS)},
cv AS (SELECT *, exp(sum(ln(greatest(0.0, 1 + net_return))) OVER (PARTITION BY scenario ORDER BY ts)) AS equity FROM pp), dd AS (SELECT *, equity / greatest(1.0, max(equity) OVER (PARTITION BY scenario ORDER BY ts)) - 1 AS drawdown FROM cv)"""


def scenario_periods(spark, sf, shuffle_seed=None):
    """One row of each scenario and decision, all through one portfolio and one replay with costs."""
    s = paper.scenarios(candidates(spark, sf), "ts", ["asset_id"], 5, 2, {"volume": F.col("score") * F.col("beta")}, shuffle_seed)
    e = F.exp(2 * F.least(F.col("forward_return"), F.lit(5)) / 50)
    held = portfolio.constrain(portfolio.top_k(s, 3, ["scenario", "ts"], LIM), ["scenario", "ts"], LIM, 1e6).withColumns({"forward_return": (e - 1) / (e + 1), "volatility": F.lit(0.02), "holding_days": F.lit(7.0)})
    return portfolio.periods(held, ["scenario", "ts"], COSTS)


@query("M18_robustness", f"""{_SC} SELECT scenario, count(*) AS periods, sum(trades)::BIGINT AS trades, round(arg_max(equity, ts) - 1, 6) + 0.0::DOUBLE AS total_return, round(min(drawdown), 6) + 0.0::DOUBLE AS max_drawdown, round(sum(cost_return), 6) AS total_cost_return,
round(avg(turnover), 6) AS average_turnover FROM dd GROUP BY scenario""")
def m18(spark, sf):
    s = portfolio.summary(scenario_periods(spark, sf), "ts", by=["scenario"])
    return rounded(s.select("scenario", "periods", "trades", "total_return", "max_drawdown", "total_cost_return", "average_turnover"))


@query("M18_shuffled_text")
def m18b(spark, sf):
    """The same summary with the scenario whose scores are permuted by Python's generator."""
    return rounded(portfolio.summary(scenario_periods(spark, sf, 23), "ts", by=["scenario"]).select("scenario", "periods", "trades", "total_return", "max_drawdown"))


@query("M19_downstream")
def m19b(spark, sf):
    """Each scenario's periods against the baseline's: effect, interval, p-value and Holm's adjustment."""
    p = scenario_periods(spark, sf).select("scenario", "ts", "net_return")
    control = p.where("scenario = 'baseline'").select("ts", F.col("net_return").alias("control"))
    both = p.where("scenario <> 'baseline'").join(control, "ts").withColumnRenamed("net_return", "candidate")
    return rounded(statistics.compare(both, ["scenario"], "ts", 8, 500, 23))


@query("M19_comparison", f"""WITH {src.ASSETS}, {src.BARS}, {LABELS}, {MD}, c AS (SELECT ts, avg(least(forward_return, 5)) AS candidate FROM md WHERE score > 0 GROUP BY ts), o AS (SELECT ts, avg(least(forward_return, 5)) AS control FROM md GROUP BY ts)
SELECT year(ts)::INTEGER AS regime, count(*) AS periods, round(avg(candidate - control), 6) + 0.0::DOUBLE AS effect, count(*) FILTER (WHERE candidate < control) AS negatives FROM c JOIN o USING (ts) GROUP BY 1""")
def m19(spark, sf):
    c = candidates(spark, sf).withColumn("y", F.least("forward_return", F.lit(5)))
    p = c.groupBy("ts").agg(F.avg(F.when(F.col("score") > 0, F.col("y"))).alias("candidate"), F.avg("y").alias("control")).where("candidate is not null")
    return rounded(p.groupBy(F.year("ts").alias("regime")).agg(F.count(F.lit(1)).alias("periods"), F.avg(F.col("candidate") - F.col("control")).alias("effect"), F.count_if(F.col("candidate") < F.col("control")).alias("negatives")))


_NOTES = """notes AS (SELECT asset_id, date_trunc('month', available_at)::DATE AS month, CASE WHEN item_id % 4 <> 0 THEN sentiment = -0.5 END AS abstained, CASE WHEN sentiment <> 0 THEN sentiment END AS semantic, CASE WHEN item_id % 3 <> 0 THEN confidence END AS raw_confidence,
  CASE WHEN item_id % 5 <> 0 THEN spam END AS uncertainty, CASE WHEN item_id % 7 <> 0 THEN relevance END AS event_confidence, author % 4 AS supporting, CASE WHEN item_id % 6 <> 0 THEN author % 3 END AS counter FROM signals)"""


def notes(spark, sf):
    unless = lambda n, c: F.when(F.col("item_id") % n != 0, c)
    return src.signals(spark, sf).select(
        "asset_id", F.trunc("available_at", "month").alias("month"), unless(4, F.col("sentiment") == -0.5).alias("abstained"), F.when(F.col("sentiment") != 0, F.col("sentiment")).alias("semantic"), unless(3, F.col("confidence")).alias("raw_confidence"),
        unless(5, F.col("spam")).alias("uncertainty"), unless(7, F.col("relevance")).alias("event_confidence"), (F.col("author") % 4).alias("supporting"), unless(6, F.col("author") % 3).alias("counter"))


@query("X10_annotation_aggregates", f"""WITH {src.SIGNALS}, {_NOTES}, e AS (SELECT *, CASE WHEN abstained IS NOT NULL THEN supporting ELSE 0 END AS su, CASE WHEN abstained IS NOT NULL THEN coalesce(counter, 0) ELSE 0 END AS co FROM notes)
SELECT asset_id, month, count(abstained) AS annotation_count, count(*) FILTER (WHERE NOT abstained) AS non_abstention_count, round(count(abstained) / count(*)::DOUBLE, 6) AS annotation_coverage, round(coalesce(avg(abstained::INTEGER), 0.0), 6) AS abstention_rate,
  round(coalesce(avg(semantic) FILTER (WHERE NOT abstained), 0.0), 6) + 0.0::DOUBLE AS semantic_mean, round(coalesce(avg(raw_confidence) FILTER (WHERE NOT abstained), 0.0), 6) AS raw_confidence_mean, round(coalesce(avg(uncertainty) FILTER (WHERE abstained IS NOT NULL), 0.0), 6) AS uncertainty_mean,
  round(coalesce(avg(event_confidence) FILTER (WHERE NOT abstained), 0.0), 6) AS event_confidence_mean, sum(su)::BIGINT AS supporting_evidence_count, sum(co)::BIGINT AS counterevidence_count, round(coalesce(sum(su) / nullif(sum(su) + sum(co), 0)::DOUBLE, 0.0), 6) AS evidence_agreement,
  count(abstained) = 0 AS missing, count(semantic) FILTER (WHERE NOT abstained) = 0 AS semantic_missing, count(raw_confidence) FILTER (WHERE NOT abstained) = 0 AS raw_confidence_missing, count(uncertainty) FILTER (WHERE abstained IS NOT NULL) = 0 AS uncertainty_missing,
  count(event_confidence) FILTER (WHERE NOT abstained) = 0 AS event_confidence_missing, sum(su) + sum(co) = 0 AS evidence_missing FROM e GROUP BY ALL""")
def x10(spark, sf):
    return rounded(textwindow.annotation_features(notes(spark, sf), ["asset_id", "month"]))


@query("J19_annotation_join", "SELECT d.doc_id, coalesce(l.toxic, -1) AS toxic, l.doc_id IS NOT NULL AS annotated FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j19(spark, sf):
    l = t(spark, sf, "labels").select("doc_id", "toxic", F.lit(True).alias("a"))
    return t(spark, sf, "documents").join(l, "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.col("a").isNotNull().alias("annotated"))


@query("A31_run_summary", "SELECT role, count(*) AS requests, round(avg(length(text)), 6) AS mean_chars, CASE WHEN count(text) = count(*) THEN sum(length(text))::BIGINT ELSE -1 END AS total_chars FROM conversations GROUP BY role")
def a31(spark, sf):
    n = F.length("text")
    return rounded(t(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("requests"), F.avg(n).alias("mean_chars"), F.when(F.count("text") == F.count(F.lit(1)), F.sum(n)).otherwise(-1).alias("total_chars")))


@query("A35_rubric", "SELECT p_partkey, (p_size + length(p_name) + length(p_brand))::BIGINT AS total, rank() OVER (PARTITION BY p_brand ORDER BY p_size + length(p_name) + length(p_brand) DESC)::INTEGER AS place FROM part")
def a35(spark, sf):
    points = {"size": F.col("p_size"), "name": F.length("p_name"), "brand": F.length("p_brand")}
    return models.rubric(t(spark, sf, "part"), points, ["p_brand"]).select("p_partkey", "total", "place")


@query("G23_content_ids", "SELECT page_id, sha256(html) = sha256(trim(html)) AS unchanged, sha256(html) AS content_id FROM pages")
def g23(spark, sf):
    return t(spark, sf, "pages").select("page_id", (F.sha2("html", 256) == F.sha2(F.trim("html"), 256)).alias("unchanged"), F.sha2("html", 256).alias("content_id"))


@query("S12_partitioned_round_trip", "SELECT regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]+', '_', 'g') AS o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def s12(spark, sf):
    """Written as partitioned Parquet and read back with its folders as a column."""
    from ..sources.checkpoints import scratch

    at = f"{scratch(spark)}/{uuid.uuid4().hex}"
    stores.write_partitioned(t(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), at, ["o_orderpriority"])
    return rounded(spark.read.parquet(at).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("F19_replay_asserts", f"WITH {src.ASSETS}, {src.BARS}, {LABELS}, {MD}, {CHAIN} SELECT ts, max(abs(weight) * 1e6 / dollar_volume) <= {LIM.max_participation_rate} + 1e-9 AS participation_ok, sum(abs(weight)) <= {LIM.max_daily_turnover} + 1e-9 AS turnover_ok, min(close) > 0 AS prices_ok FROM book WHERE abs(weight) > 1e-12 GROUP BY ts")
def f19(spark, sf):
    return portfolio.replay_checks(book(spark, sf), ["ts"], LIM)


@query("F20_label_timing", f"WITH {src.BARS}, {LABELS}, l AS (SELECT asset_id, ts, CASE WHEN seq % 11 = 0 THEN ts ELSE label_start END AS label_start, CASE WHEN seq % 13 = 0 THEN ts - 1 ELSE label_end END AS label_end FROM labels) SELECT * FROM l WHERE label_start <= ts OR label_end < label_start")
def f20(spark, sf):
    """Labels that begin no later than their decision or end before they begin; some are made so here."""
    l = market.forward_labels(src.bars(spark, sf), 1)
    l = l.withColumns({"label_start": F.when(F.col("seq") % 11 == 0, F.col("ts")).otherwise(F.col("label_start")), "label_end": F.when(F.col("seq") % 13 == 0, F.date_sub("ts", 1)).otherwise(F.col("label_end"))})
    return l.where("label_start <= ts or label_end < label_start").select("asset_id", "ts", "label_start", "label_end")


@query("F21_probability_parsing", "SELECT c_custkey, TRY_CAST(x AS DOUBLE) IS NOT NULL AND TRY_CAST(x AS DOUBLE) BETWEEN 0 AND 1 AS valid FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '0.5' WHEN 2 THEN '1.5' ELSE '1' END AS x FROM customer)")
def f21(spark, sf):
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, F.col("c_name")).when(k == 1, "0.5").when(k == 2, "1.5").otherwise("1")
    return t(spark, sf, "customer").select("c_custkey", core.probability(said).isNotNull().alias("valid"))


@query("F12_decision_window", f"WITH {src.BARS} SELECT asset_id, ts FROM bars WHERE ts BETWEEN DATE '1997-01-06' AND DATE '1998-06-29'")
def f12(spark, sf):
    return src.bars(spark, sf).where(F.col("ts").between(F.lit("1997-01-06").cast("date"), F.lit("1998-06-29").cast("date"))).select("asset_id", "ts")


@query("F02_unique_features", f"WITH {src.BARS}, b AS (SELECT asset_id, ts FROM bars UNION ALL SELECT asset_id, ts FROM bars WHERE seq % 9 = 0) SELECT asset_id, ts, count(*) AS n FROM b GROUP BY ALL HAVING count(*) > 1")
def f02(spark, sf):
    b = src.bars(spark, sf)
    return quality.duplicates(b.unionByName(b.where("seq % 9 = 0")), ["asset_id", "ts"])


_STRIP = "CASE " + " ".join(f"WHEN ends_with(lower(s_name), '{x}') THEN left(lower(s_name), -{len(x)})" for x in LEGAL_SUFFIXES) + " ELSE lower(s_name) END"


@query("C09_name_aliases", f"SELECT s_suppkey, trim({_STRIP}) AS alias FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name || ' Inc' WHEN 1 THEN s_name || ' Limited' ELSE s_name END AS s_name FROM supplier)")
def c09(spark, sf):
    k = F.col("s_suppkey") % 3
    n = F.lower(F.concat("s_name", F.when(k == 0, " Inc").when(k == 1, " Limited").otherwise("")))
    return t(spark, sf, "supplier").select("s_suppkey", F.element_at(name_aliases(n), -1).alias("alias"))
