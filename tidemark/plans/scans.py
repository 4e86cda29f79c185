"""Scans, scalars, sets, limits, checks and ledgers (S, P, F, U, T, C, G, B ids of the survey)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendars, core
from ..functions import text as T
from ..operators import broker, joins, ledger, market, models, quality
from ..operators import text as textops
from ..sources import adapters as src
from ..sources import readers
from .market import LABELS
from .registry import query, r, rounded

t = src.table


@query("S03_filtered_read", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' ORDER BY o_custkey LIMIT 500")
def s03(spark, sf):
    return readers.filtered(t(spark, sf, "orders"), {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, "o_orderdate", "1996-01-01 00:00:00", "1998-12-31 00:00:00", ["o_custkey"], "o_custkey", 500)


@query("S05_decision_times", "WITH d AS (SELECT ts::DATE AS session, max(epoch_us(ts)) AS decision FROM events GROUP BY ALL) SELECT session, decision, coalesce(decision > lag(decision) OVER (ORDER BY session), TRUE) AS increasing FROM d")
def s05(spark, sf):
    e = t(spark, sf, "events").select(F.col("ts").cast("date").alias("d"), _micros(F.col("ts")).alias("u"))
    return readers.decision_times(e, F.col("d"), F.col("u"))


def _micros(ts):
    """Microseconds since 1970 of a zoneless timestamp, whatever the session zone."""
    return (F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000 + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000
            + (F.extract(F.lit("SECOND"), ts).cast("decimal(8,6)") * 1_000_000).cast("long"))


@query("S07_nested_json", """SELECT event_id, coalesce(json_extract_string(props, '$.page'), '') AS page, len(json_keys(props)) AS n_keys FROM events""")
def s07(spark, sf):
    return t(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.page"), F.lit("")).alias("page"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("S07_normalized_items", """SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'given' ELSE sha256(lower('Clerk#' || o_custkey)) END AS author_hash, CASE WHEN o_orderkey % 5 <> 0 THEN sha256('https://x.test/' || o_custkey) END AS url_hash,
CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_entities, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 10) / 10.0::DOUBLE END AS relevance, 'original' AS relationship_type, o_orderkey % 6 <> 1 AS retention_permitted FROM orders""")
def s07b(spark, sf):
    o, k = t(spark, sf, "orders"), F.col("o_orderkey")
    entity = F.concat(F.lit('[{"name":"x","mention_type":"primary","relevance":'), ((k % 10) / 10.0).cast("string"), F.lit("}]"))
    rows = o.select(k.alias("item_id"), F.when(k % 4 != 0, F.concat(F.lit(" Clerk#"), F.col("o_custkey").cast("string"), F.lit(" "))).alias("author_handle"), F.when((k % 3 == 0) & (k % 4 != 0), "given").alias("author_hash"),
                    F.when(k % 5 != 0, F.concat(F.lit("https://x.test/"), F.col("o_custkey").cast("string"))).alias("url"), F.when(k % 2 == 0, entity).alias("entities"), F.when(k % 6 == 1, "no").when(k % 6 == 2, "").otherwise("yes").alias("retention_permitted"))
    n = readers.normalized_items(rows)
    return n.select("item_id", "author_hash", "url_hash", F.size("entities").cast("long").alias("n_entities"), F.get("entities", F.lit(0))["relevance"].alias("relevance"), "relationship_type", "retention_permitted")


@query("T04_first_decisions", f"WITH {src.BARS}, d AS (SELECT DISTINCT ts FROM bars ORDER BY ts LIMIT 10) SELECT asset_id, ts FROM bars WHERE ts IN (SELECT ts FROM d)")
def t04(spark, sf):
    b = src.bars(spark, sf).select("asset_id", "ts")
    return b.join(F.broadcast(b.select("ts").distinct().orderBy("ts").limit(10)), "ts", "left_semi").select("asset_id", "ts")


@query("P01_simple_return", "SELECT event_id, round(CASE WHEN value - 50 = 0 THEN 0.0 ELSE value / (value - 50) - 1 END, 6) + 0.0::DOUBLE AS ret FROM events")
def p01(spark, sf):
    return rounded(t(spark, sf, "events").select("event_id", core.simple_return(F.col("value"), F.col("value") - 50).alias("ret")))


@query("P02_finite_float", "SELECT c_custkey, coalesce(TRY_CAST(x AS DOUBLE), 0.0) AS v FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '1.5' WHEN 2 THEN NULL ELSE '-7' END AS x FROM customer)")
def p02(spark, sf):
    k = F.col("c_custkey") % 4
    x = F.when(k == 0, F.col("c_name")).when(k == 1, "1.5").when(k == 3, "-7")
    return t(spark, sf, "customer").select("c_custkey", core.finite(x).alias("v"))


@query("P03_first_numeric", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 2.5::DOUBLE WHEN 1 THEN 7.0 ELSE -1.0 END AS v FROM customer")
def p03(spark, sf):
    k = F.col("c_custkey") % 3
    m = F.create_map(F.lit("a"), F.when(k == 0, "2.5").otherwise("x"), F.lit("b"), F.when(k == 1, "7").otherwise("nan"))
    return t(spark, sf, "customer").select("c_custkey", F.coalesce(core.first_numeric(m, ["zz", "a", "b"]), F.lit(-1.0)).alias("v"))


@query("P04_event_slug", "SELECT DISTINCT p_type, coalesce(nullif(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'other') AS slug FROM part")
def p04(spark, sf):
    return t(spark, sf, "part").select("p_type").distinct().withColumn("slug", core.slug(F.col("p_type")))


@query("P07_horizon_steps", "SELECT p_partkey, greatest(1, coalesce(TRY_CAST(regexp_replace(p_size || 'd', '[^0-9]', '', 'g') AS INTEGER), 1)) AS steps FROM part")
def p07(spark, sf):
    return t(spark, sf, "part").select("p_partkey", core.horizon_steps(F.concat(F.col("p_size").cast("string"), F.lit("d"))).alias("steps"))


@query("P08_risk_estimates", f"""WITH {src.BARS}, f AS (SELECT asset_id, ts, (high - low) / close AS hl, close / lag(close) OVER w - 1 AS ret FROM bars WINDOW w AS (PARTITION BY asset_id ORDER BY ts)),
v AS (SELECT *, stddev_pop(ret) OVER (PARTITION BY asset_id ORDER BY ts ROWS 2 PRECEDING) AS rv, count(ret) OVER (PARTITION BY asset_id ORDER BY ts ROWS 2 PRECEDING) AS n FROM f)
SELECT asset_id, ts, round(CASE WHEN n >= 2 THEN rv ELSE greatest(0.02, hl) END, 6) AS volatility, n < 2 AS volatility_fallback_used, CASE WHEN n < 2 THEN 'volatility_fallback' ELSE '' END AS risk_flags FROM v""")
def p08(spark, sf):
    b = src.bars(spark, sf).withColumns({"hl": (F.col("high") - F.col("low")) / F.col("close"), "ret": F.col("close") / F.lag("close").over(market.by_asset()) - 1})
    w = market.by_asset().rowsBetween(-2, 0)
    few = F.count("ret").over(w) < 2
    v = F.when(few, F.greatest(F.lit(0.02), F.col("hl"))).otherwise(F.stddev_pop("ret").over(w))
    return rounded(b.select("asset_id", "ts", v.alias("volatility"), few.alias("volatility_fallback_used"), F.array_join(core.rule_flags(("volatility_fallback", few)), ",").alias("risk_flags")))


@query("P12_metric_deltas", """WITH d AS (SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id)),
m AS (SELECT lang, quality, unnest([{'metric_id': 'mean_chars', 'value': avg(n_chars)}, {'metric_id': 'rows', 'value': count(*)::DOUBLE}, {'metric_id': 'longest', 'value': max(n_chars)::DOUBLE}, {'metric_id': 'undefined', 'value': 'NaN'::DOUBLE}], recursive := true) FROM d GROUP BY lang, quality)
SELECT b.lang, b.metric_id, round(e.value - b.value, 6) + 0.0::DOUBLE AS delta FROM m b JOIN m e ON b.lang = e.lang AND b.metric_id = e.metric_id WHERE b.quality = 0 AND e.quality = 1 AND isfinite(b.value) AND isfinite(e.value)""")
def p12(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    metric = lambda n, c: F.struct(F.lit(n).alias("metric_id"), c.cast("double").alias("value"))
    m = d.groupBy("lang", "quality").agg(F.array(metric("mean_chars", F.avg("n_chars")), metric("rows", F.count(F.lit(1))), metric("longest", F.max("n_chars")), metric("undefined", F.lit(float("nan")))).alias("m"))
    m = m.select("lang", "quality", F.explode("m").alias("x")).select("lang", "quality", "x.*")
    return rounded(models.metric_deltas(m.where("quality = 0"), m.where("quality = 1"), ["lang"]))


@query("P15_tick_alignment", "SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 0.1 WHEN p_retailprice < 1500 THEN 0.5 ELSE 1.0 END::DOUBLE AS tick, (p_retailprice::DECIMAL(20,4) % CASE WHEN p_retailprice < 1000 THEN 0.1 WHEN p_retailprice < 1500 THEN 0.5 ELSE 1.0 END::DECIMAL(20,4)) = 0 AS aligned FROM part")
def p15(spark, sf):
    bands = spark.createDataFrame([(0.0, 1000.0, "0.1"), (1000.0, 1500.0, "0.5"), (1500.0, 1e12, "1.0")], "lo double, hi double, tick string")  # a fixed table of three bands
    p = t(spark, sf, "part").join(F.broadcast(bands), (F.col("p_retailprice") >= F.col("lo")) & (F.col("p_retailprice") < F.col("hi")))
    return p.select("p_partkey", F.col("tick").cast("double").alias("tick"), (F.col("p_retailprice").cast("decimal(20,4)") % F.col("tick").cast("decimal(20,4)") == 0).alias("aligned"))


@query("P16_actionable_time", f"WITH {src.SIGNALS} SELECT item_id, greatest(available_at, DATE '1996-01-01' + (item_id % 400)::INTEGER) AS actionable FROM signals")
def p16(spark, sf):
    return src.signals(spark, sf).select("item_id", core.actionable_at(F.col("available_at"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("item_id") % 400).cast("int"))).alias("actionable"))


# Fields of records as text, sound, blank and malformed.
_FIELDS = {
    "whole": ("int", "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '1.5' ELSE CAST(event_id % 90 + 1 AS VARCHAR(9)) END", "TRY_CAST(whole AS BIGINT)", "regexp_full_match(whole, '[0-9]+') AND TRY_CAST(whole AS BIGINT) >= 1"),
    "number": ("float", "CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'NaN' WHEN 2 THEN '2.5' ELSE '-7' END", "TRY_CAST(number AS DOUBLE)", "number IN ('2.5', '-7')"),
    "flag": ("bool", "CASE event_id % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN '0' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'no' WHEN 4 THEN 'maybe' ELSE '' END", "lower(trim(flag)) IN ('true', '1', 'yes')", "lower(trim(flag)) IN ('true', '1', 'yes', 'false', '0', 'no')"),
    "day": ("date", "CASE event_id % 3 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-02-29' ELSE '2024-03-01T10:00:00Z' END", "TRY_CAST(substr(day, 1, 10) AS DATE)", "TRY_CAST(substr(day, 1, 10) AS DATE) IS NOT NULL"),
    "basis": ("raw_tradable", "CASE event_id % 3 WHEN 0 THEN 'raw_tradable' WHEN 1 THEN 'adjusted' ELSE '' END", "basis", "basis = 'raw_tradable'"),
}


@query("P20_coercers", "WITH f AS (SELECT event_id, " + ", ".join(f"nullif({e}, '') AS {n}" for n, (_, e, _, _) in _FIELDS.items()) + " FROM events) SELECT event_id, "
       + ", ".join(f"CASE WHEN {ok} THEN {v} END AS {n}, {n} IS NULL OR coalesce({ok}, FALSE) AS {n}_sound" for n, (_, _, v, ok) in _FIELDS.items()) + " FROM f")
def p20(spark, sf):
    e = t(spark, sf, "events").select("event_id", *(F.expr(x).alias(n) for n, (_, x, _, _) in _FIELDS.items()))
    return e.select("event_id", *(c.alias(a) for n, (kind, _, _, _) in _FIELDS.items() for c, a in zip(core.coerced(F.col(n), kind), (n, f"{n}_sound"), strict=True)))


@query("F01_pit_violations", "SELECT o_orderkey, min(l_shipdate)::DATE AS first_ship FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 100 DAY GROUP BY o_orderkey")
def f01(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 100).alias("asof_ts"), F.col("o_orderdate").alias("o"))
    l = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("date").alias("ship_available_at"))
    return quality.future_inputs(o.select("o_orderkey", "asof_ts").join(l, "o_orderkey")).groupBy("o_orderkey").agg(F.min("ship_available_at").alias("first_ship"))


@query("F06_active_assets", "SELECT s_suppkey, (s_suppkey % 3 = 0 OR DATE '1996-06-01' >= DATE '1996-01-01' + (s_suppkey % 300)::INTEGER) AS active FROM supplier")
def f06(spark, sf):
    start = F.when(F.col("s_suppkey") % 3 != 0, F.date_add(F.lit("1996-01-01").cast("date"), (F.col("s_suppkey") % 300).cast("int")))
    return t(spark, sf, "supplier").select("s_suppkey", calendars.is_active(F.lit("1996-06-01").cast("date"), start, F.lit(None).cast("date")).alias("active"))


@query("F13_all_or_none", "SELECT lang, count(*) AS n, count(quality) AS given FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id GROUP BY lang HAVING count(quality) > 0 AND count(quality) < count(*)")
def f13(spark, sf):
    return quality.all_or_none(t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left"), "quality", ["lang"])


@query("F14_record_contract", "SELECT p_partkey, regexp_matches(code, '^[1-9][0-9ACDF-HJ-NPR-UW-Y][0-9][0-9ACDF-HJ-NPR-UW-Y]$') AS valid FROM (SELECT p_partkey, substr(upper(md5(p_name)), 1, 4) AS code FROM part)")
def f14(spark, sf):
    code = F.substring(F.upper(F.md5("p_name")), 1, 4)
    return t(spark, sf, "part").select("p_partkey", core.is_security_code(code).alias("valid"))


@query("F15_unknown_references", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def f15(spark, sf):
    known = t(spark, sf, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return quality.unknown_references(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), known, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("F23_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def f23(spark, sf):
    return quality.duplicates(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("F25_incomplete_pairs", "SELECT n.s_nationkey, p.p FROM (SELECT DISTINCT s_nationkey FROM supplier) n, (SELECT DISTINCT s_suppkey % 7 AS p FROM supplier) p WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.s_nationkey AND s.s_suppkey % 7 = p.p)")
def f25(spark, sf):
    s = t(spark, sf, "supplier").select("s_nationkey", (F.col("s_suppkey") % 7).alias("p"))
    return quality.incomplete_pairs(s, s, s, ("s_nationkey", "p"))


@query("U05_array_tests", "WITH a AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY ALL) SELECT o_custkey, len(list_intersect(s, ['F', 'P'])) AS common, list_has_all(['F', 'O'], s) AS subset FROM a")
def u05(spark, sf):
    a = t(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    lit = lambda *x: F.array(*map(F.lit, x))
    return a.select("o_custkey", F.size(F.array_intersect("s", lit("F", "P"))).cast("long").alias("common"), (F.size(F.array_except("s", lit("F", "O"))) == 0).alias("subset"))


@query("U06_jaccard", "WITH k AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE, 6) AS j FROM k a JOIN k b ON a.item_id + 1 = b.item_id")
def u06(spark, sf):
    k = t(spark, sf, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    b = k.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("t").alias("tb"))
    return rounded(k.join(b, "item_id").select(F.col("item_id").alias("a"), "b", T.jaccard(F.col("t"), F.col("tb")).alias("j")))


@query("U07_ordered_distinct", "WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS roles FROM c")
def u07(spark, sf):
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return c.select("conv_id", F.array_join(F.array_distinct(F.transform("r", lambda x: x["role"])), ",").alias("roles"))


@query("W22_label_availability", f"WITH {src.BARS}, {LABELS} SELECT asset_id, ts, coalesce(label_end, lead(ts, 2) OVER (PARTITION BY asset_id ORDER BY ts)) AS available FROM labels")
def w22(spark, sf):
    l = market.forward_labels(src.bars(spark, sf), 1)
    return l.select("asset_id", "ts", F.coalesce("label_end", F.lead("ts", 2).over(market.by_asset())).alias("available"))


@query("W24_purged_suffix", f"WITH {src.BARS}, {LABELS}, g AS (SELECT ts, bool_and(coalesce(label_end < DATE '2000-01-03', FALSE)) AS ok FROM labels WHERE ts < DATE '2000-01-03' GROUP BY ts) SELECT ts, min(ok) OVER (ORDER BY ts) AS kept FROM g")
def w24(spark, sf):
    l = market.forward_labels(src.bars(spark, sf), 1).where(F.col("ts") < F.lit("2000-01-03").cast("date"))
    g = l.groupBy("ts").agg(F.bool_and(F.coalesce(F.col("label_end") < F.lit("2000-01-03").cast("date"), F.lit(False))).alias("ok"))
    return g.select("ts", F.min("ok").over(Window.orderBy("ts")).alias("kept"))  # one row per decision


@query("W30_endpoint_shift", f"WITH {src.BARS}, d AS (SELECT DISTINCT ts FROM bars), k AS (SELECT ts, row_number() OVER (ORDER BY ts) AS a, row_number() OVER (ORDER BY ts DESC) AS z FROM d) SELECT 'early' AS scenario, count(*) AS n, min(ts) AS first, max(ts) AS last FROM k WHERE z > 5 UNION ALL SELECT 'late', count(*), min(ts), max(ts) FROM k WHERE a > 5")
def w30(spark, sf):
    d = src.bars(spark, sf).select("ts").distinct()
    k = d.select("ts", F.row_number().over(Window.orderBy("ts")).alias("a"), F.row_number().over(Window.orderBy(F.desc("ts"))).alias("z"))
    s = k.withColumn("scenario", F.explode(F.array_compact(F.array(F.when(F.col("z") > 5, F.lit("early")), F.when(F.col("a") > 5, F.lit("late"))))))
    return s.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


_PAY = "conv_id || ':' || turn || ':' || role || ':' || text"


def _payload():
    return F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text")


@query("W31_hash_chain", f"SELECT conv_id, turn, sha256({_PAY}) AS event_hash, coalesce(lag(sha256({_PAY})) OVER (PARTITION BY conv_id ORDER BY turn), '') AS previous_hash FROM conversations")
def w31(spark, sf):
    return ledger.chained(t(spark, sf, "conversations"), ["conv_id"], "turn", _payload()).select("conv_id", "turn", "event_hash", "previous_hash")


@query("W31_chain_violations", f"""WITH c AS (SELECT conv_id, turn, sha256({_PAY}) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, (turn * 7 + conv_id) % 11 AS clock FROM conversations WHERE role <> 'assistant'),
v AS (SELECT conv_id, turn, turn <> k AS a, coalesce(clock < lag(clock) OVER (PARTITION BY conv_id ORDER BY turn), FALSE) AS b FROM c)
SELECT conv_id, turn, CASE WHEN a AND b THEN 'sequence,time' WHEN a THEN 'sequence' ELSE 'time' END AS broken FROM v WHERE a OR b""")
def w31b(spark, sf):
    c = t(spark, sf, "conversations").where("role <> 'assistant'").withColumn("at", (F.col("turn") * 7 + F.col("conv_id")) % 11)  # the log with its answers lost and its clock set back now and then
    log = ledger.chained(c, ["conv_id"], "turn", _payload())
    return ledger.verify_chain(log, ["conv_id"], "turn", _payload(), "at").select("conv_id", "turn", F.array_join("broken", ",").alias("broken"))


_STATES = {("idle", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked", ("idle", "system"): "idle", ("asked", "system"): "asked"}


@query("G08_event_fold", "WITH RECURSIVE e AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i FROM conversations), f AS (SELECT conv_id, 0::BIGINT AS i, 'idle' AS state, 0::BIGINT AS bad FROM (SELECT DISTINCT conv_id FROM e) UNION ALL SELECT f.conv_id, e.i, coalesce(x.t, f.state), f.bad + (x.t IS NULL)::INTEGER FROM f JOIN e ON e.conv_id = f.conv_id AND e.i = f.i + 1 LEFT JOIN (VALUES "
       + ", ".join(f"('{a}', '{b}', '{c}')" for (a, b), c in _STATES.items()) + ") x(s, r, t) ON x.s = f.state AND x.r = e.role) SELECT conv_id, arg_max(state, i) AS state, max(i) AS n_events, max(bad) AS n_invalid FROM f GROUP BY conv_id")
def g08(spark, sf):
    return ledger.fold(t(spark, sf, "conversations"), ["conv_id"], "turn", "role", _STATES, "idle")


@query("B02_unresolved", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) IN ('click', 'view')")
def b02(spark, sf):
    return ledger.unresolved(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", ["click", "view"])


@query("A33_daily_notional", "WITH o AS (SELECT ts::DATE AS day, user_id, min(value) AS lo, max(value) AS hi FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT day, round(sum(CASE WHEN lo = hi THEN lo ELSE 0 END), 6) AS notional, count(*) FILTER (WHERE lo <> hi) AS conflicts FROM o GROUP BY day")
def a33(spark, sf):
    e = t(spark, sf, "events").where("event_type = 'purchase'").select(F.col("ts").cast("date").alias("day"), "user_id", "value")
    return rounded(ledger.daily_notional(e, "user_id", "day", "value"))


@query("A34_positions", "SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END)::DOUBLE AS position, count(*) FILTER (WHERE l_linestatus = 'O') AS open_orders, round(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 2) AS pending FROM lineitem GROUP BY l_suppkey")
def a34(spark, sf):
    l = t(spark, sf, "lineitem")
    op = F.col("l_linestatus") == "O"
    return rounded(l.groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))).cast("double").alias("position"), F.count_if(op).alias("open_orders"),
                                              F.sum(F.when(op, F.col("l_extendedprice"))).alias("pending")), 2)


@query("B07_cancel_state", "WITH d AS (SELECT l_orderkey, list(l_linestatus) AS s FROM lineitem GROUP BY ALL) SELECT l_orderkey, CASE WHEN NOT list_contains(s, 'O') THEN 'cancelled' WHEN list_contains(s, 'F') THEN 'partial' ELSE 'open' END AS state FROM d")
def b07(spark, sf):
    return broker.cancel_state(t(spark, sf, "lineitem"), "l_orderkey", "l_linestatus", "O", "F")


# Orders made of line items: every rule of the checks is broken by some.
_ORDER = {
    "side": "CASE l_returnflag WHEN 'R' THEN 'sell' WHEN 'A' THEN 'buy' ELSE CASE WHEN l_linenumber = 7 THEN 'hold' ELSE 'buy' END END", "quantity": "CAST(l_quantity AS BIGINT) * 10 - CASE WHEN l_partkey % 97 = 0 THEN 600 ELSE 0 END",
    "limit_price": "CAST(1000 + l_partkey % 4500 AS DOUBLE)", "now": "CAST(l_orderkey AS BIGINT)", "expires_at": "CAST(l_orderkey + l_suppkey % 50 AS BIGINT)", "quote_at": "CAST(l_orderkey - l_suppkey % 40 + 2 AS BIGINT)",
    "trading_unit": "CAST(CASE WHEN l_linenumber = 3 THEN 100 ELSE 10 END AS BIGINT)", "lower_limit": "CAST(1200 + CASE WHEN l_partkey % 53 = 0 THEN 9000 ELSE 0 END AS DOUBLE)", "upper_limit": "CAST(5400 AS DOUBLE)",
    "quote": "CASE WHEN l_partkey % 61 = 0 THEN NULL ELSE (1000 + l_partkey % 4500) * (1 + (l_suppkey % 9 - 4) / CAST(100 AS DOUBLE)) END", "open_orders": "l_orderkey % 23", "symbol_orders": "l_partkey % 6", "unrealized": "CAST(-(l_orderkey % 110) * 1000 AS DOUBLE)",
    "soft_limit": "CAST(500000 + l_suppkey % 7 * 100000 AS DOUBLE)", "buying_power": "CAST(l_orderkey % 17 * 120000 AS DOUBLE)", "held": "l_partkey % 700", "available": "l_partkey % 500", "pending": "l_suppkey % 300",
    "symbol_notional": "CAST(l_partkey % 2000 * 800 AS DOUBLE)", "pending_symbol_notional": "CAST(l_suppkey % 100 * 2000 AS DOUBLE)", "gross_notional": "CAST(l_orderkey % 4000 * 1100 AS DOUBLE)", "pending_notional": "CAST(l_suppkey % 100 * 5000 AS DOUBLE)",
    "symbol_limit": "CASE WHEN l_linenumber = 2 THEN CAST(900000 AS DOUBLE) END", "unresolved": "CASE WHEN l_orderkey % 31 = 0 THEN 1 ELSE 0 END", "kill_switch": "l_orderkey % 41 = 0",
}
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_RULES = (
    ("kill_switch", "kill_switch"), ("unresolved_order", "unresolved > 0"), ("open_orders", "open_orders >= 20"), ("unrealized_loss", "unrealized <= -100000"), ("symbol_orders", "symbol_orders >= 5"), ("side", "side = 'hold'"), ("quantity", "quantity <= 0"),
    ("trading_unit", "quantity % trading_unit <> 0"), ("tick", "limit_price % (CASE WHEN limit_price <= 3000 THEN 1.0 WHEN limit_price <= 5000 THEN 5.0 ELSE 10.0 END) <> 0"), ("inconsistent_limits", "lower_limit > upper_limit"), ("price_range", "limit_price NOT BETWEEN lower_limit AND upper_limit"),
    ("no_quote", "quote IS NULL"), ("stale_quote", "quote_at > now OR now - quote_at > 30"), ("quote_deviation", "quote IS NULL OR abs(limit_price / quote - 1) * 10000 > 300"), ("order_notional", "n <= 0 OR n > 1000000"), ("soft_limit", "n > soft_limit"),
    ("buying_power", "side = 'buy' AND n > buying_power"), ("position_quantity", "side = 'buy' AND held + pending + quantity > 1000"), ("symbol_notional", "side = 'buy' AND symbol_notional + pending_symbol_notional + n > 2000000"),
    ("broker_symbol_limit", "side = 'buy' AND symbol_notional + pending_symbol_notional + n > symbol_limit"), ("gross_notional", "side = 'buy' AND gross_notional + pending_notional + n > 5000000"), ("available", "side = 'sell' AND quantity > available"), ("expired", "expires_at <= now"))


@query("B05_pretrade_checks", "WITH o AS (SELECT " + ", ".join([*_KEYS, *(f"{e} AS {n}" for n, e in _ORDER.items())]) + " FROM lineitem), p AS (SELECT *, limit_price * quantity AS n FROM o) SELECT " + ", ".join(_KEYS) + ", array_to_string(list_filter(["
       + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES) + "], lambda x: x IS NOT NULL), ',') AS failed FROM p")
def b05(spark, sf):
    o = t(spark, sf, "lineitem").select(*_KEYS, *(F.expr(e).alias(n) for n, e in _ORDER.items()))
    return broker.pretrade(o, broker.OrderLimits()).select(*_KEYS, F.array_join("failed", ",").alias("failed"))


@query("A26_holding_days", "WITH e AS (SELECT user_id, epoch_us(ts) AS u, event_id, event_type = 'purchase' AS held FROM events), f AS (SELECT *, lag(held) OVER (PARTITION BY user_id ORDER BY u, event_id) AS before FROM e), c AS (SELECT * FROM f WHERE before IS NULL OR before <> held), d AS (SELECT *, lead(u) OVER (PARTITION BY user_id ORDER BY u, event_id) AS until FROM c) SELECT user_id, count(*) AS closed, round(avg((until - u) / 86400e6), 6) AS mean_days FROM d WHERE held AND until IS NOT NULL GROUP BY user_id")
def a26(spark, sf):
    w = Window.partitionBy("user_id").orderBy("u", "event_id")
    e = t(spark, sf, "events").select("user_id", _micros(F.col("ts")).alias("u"), "event_id", (F.col("event_type") == "purchase").alias("held"))
    c = e.withColumn("before", F.lag("held").over(w)).where("before is null or before <> held").withColumn("until", F.lead("u").over(w))
    return rounded(c.where("held and until is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("closed"), F.avg((F.col("until") - F.col("u")) / 86400e6).alias("mean_days")))


@query("A30_check_counts", "SELECT name, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed FROM (SELECT 'long' AS name, n_chars >= 200 AS ok FROM documents UNION ALL SELECT 'english', lang = 'en' FROM documents) GROUP BY name")
def a30(spark, sf):
    checks = F.array(F.struct(F.lit("long").alias("name"), (F.col("n_chars") >= 200).alias("ok")), F.struct(F.lit("english").alias("name"), (F.col("lang") == "en").alias("ok")))
    x = t(spark, sf, "documents").select(F.explode(checks).alias("c")).select("c.*")
    return x.groupBy("name").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


@query("A36_period_bounds", f"WITH {src.BARS} SELECT count(DISTINCT asset_id) AS assets, min(ts) AS first, max(ts) AS last FROM bars")
def a36(spark, sf):
    return src.bars(spark, sf).agg(F.count_distinct("asset_id").alias("assets"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("A38_metric_flatten", "WITH m AS (SELECT lang, round(avg(n_chars), 6) AS mean_chars, max(n_chars)::DOUBLE AS max_chars FROM documents GROUP BY lang) SELECT lang AS family, 'mean_chars' AS metric_id, mean_chars AS value FROM m UNION ALL SELECT lang, 'max_chars', max_chars FROM m")
def a38(spark, sf):
    m = t(spark, sf, "documents").groupBy(F.col("lang").alias("family")).agg(F.avg("n_chars").alias("mean_chars"), F.max("n_chars").cast("double").alias("max_chars"))
    return rounded(m.unpivot(["family"], ["mean_chars", "max_chars"], "metric_id", "value"))


@query("C16_canonical_hash", "SELECT c_custkey, sha256('{\"c_acctbal\":\"' || c_acctbal::DECIMAL(15,2)::VARCHAR || '\",\"c_name\":\"' || c_name || '\"}') AS content_id FROM customer")
def c16(spark, sf):
    j = F.to_json(F.struct(F.col("c_acctbal").cast("decimal(15,2)").cast("string").alias("c_acctbal"), "c_name"))  # fields in sorted order
    return t(spark, sf, "customer").select("c_custkey", F.sha2(j, 256).alias("content_id"))


@query("C17_sessions")
def c17(spark, sf):
    """The sessions of the years that have events, and how many events fall into each."""
    e = t(spark, sf, "events").select(F.to_date("ts").alias("session_date"), F.col("ts").cast("timestamp").alias("at"))
    first, last = e.agg(F.min("session_date"), F.max("session_date")).first()
    years = (first or date(2024, 1, 1)).year, (last or date(2024, 1, 1)).year
    c = calendars.neighbours(calendars.sessions(spark, "XNYS", date(years[0], 1, 1), date(years[1], 12, 31)))
    n = e.join(F.broadcast(c.select("session_date", "open_utc", "close_utc")), "session_date").where((F.col("at") >= F.col("open_utc")) & (F.col("at") < F.col("close_utc"))).groupBy("session_date").agg(F.count(F.lit(1)).alias("events"))
    return c.join(n, "session_date", "left").select("session_seq", "session_date", F.unix_seconds("open_utc").alias("open_s"), F.unix_seconds("close_utc").alias("close_s"), "early_close", "previous_session", "next_session", F.coalesce("events", F.lit(0)).alias("events"))


@query("C20_drift_weights", "WITH b AS (SELECT l_orderkey AS k, l_linenumber AS a, min(l_quantity) / 200.0 AS w, min(l_discount) AS r FROM lineitem GROUP BY ALL), g AS (SELECT *, sum(w * r) OVER (PARTITION BY k) AS p FROM b) SELECT k, a, round(w * (1 + r) / (1 + p), 6)::DOUBLE AS drifted FROM g WHERE 1 + p > 0 AND abs(w) > 1e-12")
def c20(spark, sf):
    b = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("a")).agg((F.min("l_quantity") / 200.0).alias("w"), F.min("l_discount").alias("r"))
    g = b.withColumn("p", F.sum(F.col("w") * F.col("r")).over(Window.partitionBy("k"))).where("1 + p > 0 and abs(w) > 1e-12")
    return rounded(g.select("k", "a", (F.col("w") * (1 + F.col("r")) / (1 + F.col("p"))).alias("drifted")))


@query("C22_calculate", "SELECT user_id, round(sum(value), 6) AS sum, round(avg(value), 6) AS mean, round(coalesce(stddev_pop(value), 0), 6) AS population_stddev, round(coalesce(stddev_samp(value), 0), 6) AS sample_stddev FROM events GROUP BY user_id")
def c22(spark, sf):
    return rounded(t(spark, sf, "events").groupBy("user_id").agg(F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("population_stddev"),
                                                                  F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sample_stddev")))


@query("C25_annotation_rules", "SELECT doc_id, array_to_string(list_filter([CASE WHEN toxic = 1 AND quality = 1 THEN 'toxic_quality' END, CASE WHEN quality = 0 THEN 'low_quality' END], lambda x: x IS NOT NULL), ',') AS broken FROM labels")
def c25(spark, sf):
    f = core.rule_flags(("toxic_quality", (F.col("toxic") == 1) & (F.col("quality") == 1)), ("low_quality", F.col("quality") == 0))
    return t(spark, sf, "labels").select("doc_id", F.array_join(f, ",").alias("broken"))


@query("G01_evidence_snapshot", """WITH d AS (SELECT doc_id, text, DATE '2024-01-01' + (doc_id % 97)::INTEGER AS since, source NOT IN ('src3', 'src7') AS allowed FROM documents UNION ALL SELECT doc_id, text || ' again', DATE '2024-01-01' + (doc_id % 97 + 5)::INTEGER, TRUE FROM documents WHERE doc_id % 10 = 0),
u AS (SELECT * FROM d WHERE since <= DATE '2024-03-15' AND allowed AND text <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY since, text) = 1)
SELECT u.doc_id, c.i AS span, length(substr(u.text, c.i * 1024 + 1, 1024)) AS n FROM u, (SELECT doc_id, unnest(range(0, (length(text) + 1023) // 1024)) AS i FROM u) c WHERE c.doc_id = u.doc_id""")
def g01(spark, sf):
    d = t(spark, sf, "documents")
    at = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 97).cast("int"))
    rows = d.select("doc_id", "text", at.alias("at"), (~F.col("source").isin("src3", "src7")).alias("allowed"))
    again = d.where("doc_id % 10 = 0").select("doc_id", F.concat("text", F.lit(" again")).alias("text"), F.date_add(at, 5).alias("at"), F.lit(True).alias("allowed"))  # later versions
    return textops.evidence_snapshot(rows.unionByName(again), "doc_id", "at", "2024-03-15", "allowed", 1024).select("doc_id", "span", F.length("text").cast("long").alias("n"))


@query("W10_event_cross_section", f"WITH {src.DAILY}, k AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY close) - 1 + (count(*) OVER (PARTITION BY ts, close) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY ts) AS m FROM daily) SELECT asset_id, ts, n, {r('volume', 'close')}, round(CASE WHEN m = 1 THEN 0.5 ELSE k / (m - 1) END, 6)::DOUBLE AS rank_pct FROM k")
def w10(spark, sf):
    d = src.daily(spark, sf).withColumn("sector", F.lit("all"))
    return rounded(market.cross_section(d, "ts", "close").select("asset_id", "ts", "n", "volume", "close", "rank_pct"))


@query("J10_snapshot_asof", f"WITH {src.BARS}, d AS (SELECT asset_id, (ts - DATE '1970-01-01')::BIGINT AS at FROM bars), s AS (SELECT 'N' || c_nationkey AS asset_id, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS day, count(*) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '5-LOW' GROUP BY ALL) SELECT d.asset_id, d.at, coalesce(s.day, -1) AS day, coalesce(s.v, 0) AS v FROM d ASOF LEFT JOIN s ON s.asset_id = d.asset_id AND s.day <= d.at")
def j10(spark, sf):
    o = t(spark, sf, "orders").where("o_orderpriority = '5-LOW'").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = o.groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("asset_id"), src.day(F.col("o_orderdate").cast("date")).alias("d")).agg(F.count(F.lit(1)).alias("v")).withColumn("day", F.col("d"))
    d = src.bars(spark, sf).select("asset_id", src.day(F.col("ts")).alias("at"))
    out = joins.asof_backward(d, s, ["asset_id"], "at", "d", ["day", "v"])
    return out.select("asset_id", "at", F.coalesce("day", F.lit(-1)).alias("day"), F.coalesce("v", F.lit(0)).alias("v"))
