"""Projections, filters, joins, set operations and stores (P, F, J, U, C, S, B, G ids of the survey)."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import core
from ..operators import broker, inference, joins, market, portfolio, quality
from ..operators import text as textops
from ..functions import text as T
from ..sources import adapters as src
from ..sources import readers, stores, synthetic
from ..sources.checkpoints import scratch
from .joins import DEC, SIG, decisions, signals
from .market import LABELS, W
from .models import CHAIN, LIM, MD, candidates
from .registry import ORACLES, QUERIES, query, r, rounded
from .text import PRE, TOKS

t = src.table


def _folder(spark) -> str:
    return f"{scratch(spark)}/{uuid.uuid4().hex}"


def flags(*rules: tuple[str, str]) -> str:
    """SQL: the names of the rules that hold, comma-joined."""
    return "coalesce(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules) + "], lambda x: x IS NOT NULL), ','), '')"


@query("P05_price_basis", f"""WITH {src.BARS}, v AS (SELECT asset_id, ts, CASE WHEN seq % 5 <= 3 THEN close * (1 + (seq % 7 + 1) / 1100.0::DOUBLE) END AS price FROM bars)
SELECT asset_id, ts, round(price, 6) AS price, price IS NULL AS from_the_future FROM v""")
def p05(spark, sf):
    b = src.bars(spark, sf).withColumns({"factor": 1 + (F.col("seq") % 7 + 1) / F.lit(1100.0), "vintage": F.col("seq") % 5, "available": F.lit(3)})
    price = core.price_as_known(F.col("close"), F.col("factor"), F.col("vintage"), F.col("available"))
    return rounded(b.select("asset_id", "ts", price.alias("price"), price.isNull().alias("from_the_future")))


@query("P06_utc_text", r"""SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\.000000$', '') || 'Z' AS at, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS second FROM events""")
def p06(spark, sf):
    return t(spark, sf, "events").select("event_id", core.format_utc(F.col("ts")).alias("at"), core.format_utc(F.date_trunc("second", "ts")).alias("second"))


@query("P09_risk_flags", f"""WITH {src.BARS}, x AS (SELECT asset_id, ts, lag(close) OVER w IS NULL AS b, high = low AS v FROM bars {W})
SELECT asset_id, ts, {flags(('missing_beta_conservative_fallback', 'b'), ('missing_volatility_conservative_fallback', 'v'))} AS flags FROM x""")
def p09(spark, sf):
    first = F.lag("close").over(market.by_asset()).isNull()
    b = src.bars(spark, sf).withColumns({"b": first, "v": F.col("high") == F.col("low")})
    named = core.rule_flags(("missing_beta_conservative_fallback", F.col("b")), ("missing_volatility_conservative_fallback", F.col("v")))
    return b.select("asset_id", "ts", F.array_join(named, ",").alias("flags"))


@query("P10_passthrough", "SELECT doc_id, lang, source FROM documents")
def p10(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", *core.passthrough(d, ["lang", "model_version", "source", "regime"]))


@query("P13_bound_expansion", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts <= TIMESTAMP '2024-01-05 23:59:59.999999'")
def p13(spark, sf):
    e = t(spark, sf, "events")
    start, end = readers.day_bounds("2024-01-02", "2024-01-05")
    return readers.filtered(e, time_field="ts", start=start, end=end, select=["event_id", "user_id"])


@query("P14_metric_units", f"""WITH m AS (SELECT COLUMNS(* EXCLUDE (segment))::DOUBLE FROM ({ORACLES['A16_prediction_metrics']})), u AS (UNPIVOT m ON COLUMNS(*) INTO NAME m VALUE v)
SELECT m AS metric_id, round(v, 6) + 0.0::DOUBLE AS value, CASE WHEN m IN ('dates', 'ic_dates', 'rows', 'periods', 'trades') THEN 'count' WHEN contains(m, 'return') OR m IN ('hit_rate', 'precision_at_k', 'max_drawdown') THEN 'ratio'
WHEN m IN ('final_equity', 'minimum_capacity_proxy_equity') THEN 'equity_multiple' WHEN m = 'average_holding_period_days' THEN 'days' ELSE 'coefficient' END AS unit FROM u""")
def p14(spark, sf):
    """The metrics of all predictions, each with its unit."""
    m = QUERIES["A16_prediction_metrics"](spark, sf).drop("segment")
    rows = m.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric_id"), F.col(c).cast("double").alias("value")) for c in m.columns))).alias("m")).select("m.*").where("value IS NOT NULL")
    return rounded(rows.withColumn("unit", core.metric_unit(F.col("metric_id"))))


@query("P17_row_volatility", f"""WITH {src.BARS}, x AS (SELECT asset_id, ts, CASE WHEN seq % 4 <> 0 THEN close / open - 1 END AS v, (high - low) / ((high + low) / 2) AS f FROM bars)
SELECT asset_id, ts, round(greatest(0.0, coalesce(v, f)), 6) + 0.0::DOUBLE AS volatility, round(greatest(0.0, coalesce(v, f)) * 0.5 * 1.5, 6) + 0.0::DOUBLE AS scaled_cost FROM x""")
def p17(spark, sf):
    own = F.when(F.col("seq") % 4 != 0, F.col("close") / F.col("open") - 1)
    vol = core.row_volatility(own, F.col("high"), F.col("low"))
    return rounded(src.bars(spark, sf).select("asset_id", "ts", vol.alias("volatility"), (vol * 0.5 * 1.5).alias("scaled_cost")))


@query("P18_nested_to_json", "SELECT conv_id, to_json(list({'turn': turn, 'role': role} ORDER BY turn, role))::VARCHAR AS turns FROM conversations WHERE role IS NOT NULL GROUP BY conv_id")
def p18(spark, sf):
    c = t(spark, sf, "conversations").where("role is not null")
    return c.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role")))).alias("turns"))


@query("P19_flat_features", f"WITH {src.BARS} SELECT asset_id, ts, close, volume, NULL::DOUBLE AS unknown FROM bars")
def p19(spark, sf):
    rows = src.bars(spark, sf).select("asset_id", "ts", F.create_map(F.lit("close"), F.col("close"), F.lit("volume"), F.col("volume")).alias("values"))
    return core.flatten_map(rows, "values", ["close", "volume", "unknown"])


@query("F03_off_calendar", "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders WHERE isodow(o_orderdate::DATE) > 5")
def f03(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    days = spark.range((date(2010, 1, 1) - date(1990, 1, 1)).days).select(F.date_add(F.lit(date(1990, 1, 1)), F.col("id").cast("int")).alias("d")).where(F.weekday("d") < 5)
    return quality.off_calendar(o, days, "d").select("o_orderkey", "d")


@query("F11_holdout_rows", f"""WITH {src.BARS}, {LABELS}, w AS (SELECT ts FROM labels GROUP BY ts HAVING bool_and(coalesce(label_start >= DATE '1996-01-01' AND label_end <= DATE '1998-06-30', FALSE)))
SELECT asset_id, ts, round(forward_return, 6) + 0.0::DOUBLE AS forward_return FROM labels WHERE ts IN (SELECT ts FROM w)""")
def f11(spark, sf):
    l = market.forward_labels(src.bars(spark, sf), 1)
    return rounded(quality.outcome_rows(l, "ts", "1996-01-01", "1998-06-30").select("asset_id", "ts", "forward_return"))


_SECTORS = "sx AS (SELECT ts, max(abs(w0)) AS p, sum(abs(w0)) AS g, sum(w0) AS n, sum(w0 * beta) AS b FROM t0 GROUP BY ts, sector)"


@query("F17_limit_violations", f"""WITH {src.ASSETS}, {src.BARS}, {LABELS}, {MD}, {_SECTORS} SELECT ts, {flags(('max_position_weight', f'max(p) > {LIM.max_position_weight} + 1e-6'), ('max_gross_exposure', f'sum(g) > {LIM.max_gross_exposure} + 1e-6'),
  ('max_net_exposure', f'abs(sum(n)) > {LIM.max_net_exposure} + 1e-6'), ('max_beta_exposure', f'abs(sum(b)) > {LIM.max_beta_exposure} + 1e-6'), ('max_sector_weight', f'max(g) > {LIM.max_sector_weight} + 1e-6'))} AS violated FROM sx GROUP BY ts""")
def f17(spark, sf):
    raw = portfolio.violations(portfolio.top_k(candidates(spark, sf), 6, ["ts"], LIM), ["ts"], LIM, 1e-6)
    return raw.select("ts", F.array_join("violated", ",").alias("violated"))


@query("F26_forbidden_keys", "SELECT event_id FROM events WHERE list_has_any(json_keys(props), ['k', 'holdout'])")
def f26(spark, sf):
    return quality.forbidden_keys(t(spark, sf, "events"), "props", ["k", "holdout"]).select("event_id")


@query("F27_study_rows", f"""WITH {src.SIGNALS}, s AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS k FROM signals)
SELECT item_id, {flags(('outside_period', "available_at < DATE '1993-01-01' OR available_at > DATE '1997-12-31'"), ('inactive_asset', "asset_id IN ('N3', 'N7')"), ('repeated_item', 'k > 1'))} AS findings FROM s""")
def f27(spark, sf):
    s = src.signals(spark, sf).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    found = core.rule_flags(("outside_period", ~F.col("available_at").between(F.lit("1993-01-01").cast("date"), F.lit("1997-12-31").cast("date"))), ("inactive_asset", F.col("asset_id").isin("N3", "N7")), ("repeated_item", F.col("k") > 1))
    return s.select("item_id", F.array_join(found, ",").alias("findings"))


@query("J05_prior_window", f"""WITH {src.BARS}, {src.SIGNALS}, {SIG}, {DEC} SELECT d.asset_id, d.asof_day, count(*) FILTER (WHERE d.asof_day - s.avail < 7) AS now, count(*) FILTER (WHERE d.asof_day - s.avail >= 7) AS prior
FROM dec d JOIN sig s ON s.asset_id = d.asset_id AND s.avail <= d.asof_day AND s.avail > d.asof_day - 14 GROUP BY ALL""")
def j05(spark, sf):
    age = F.col("asof_day") - F.col("avail")
    return joins.range_join(decisions(spark, sf), signals(spark, sf), ["asset_id"], "asof_day", "avail", 14).groupBy("asset_id", "asof_day").agg(
        F.count(F.when(age < 7, 1)).alias("now"), F.count(F.when(age >= 7, 1)).alias("prior"))


@query("J08_next_action", f"""WITH {src.BARS}, {src.SIGNALS}, {SIG}, {DEC}, a AS (SELECT asset_id, avail, count(*) AS n FROM sig WHERE lower(event_type) IN ('p', 'f') AND sentiment > 0.9 GROUP BY ALL)
SELECT d.asset_id, d.asof_day, a.avail AS next_day, a.n FROM dec d ASOF LEFT JOIN a ON a.asset_id = d.asset_id AND a.avail > d.asof_day""")
def j08(spark, sf):
    s = signals(spark, sf).where(F.lower("event_type").isin("p", "f") & (F.col("sentiment") > 0.9))
    a = s.groupBy("asset_id", "avail").agg(F.count(F.lit(1)).alias("n")).withColumn("next_day", F.col("avail"))
    return joins.asof_forward(decisions(spark, sf), a, ["asset_id"], "asof_day", "avail", ["next_day", "n"]).select("asset_id", "asof_day", "next_day", "n")


@query("J12_label_horizon", f"""WITH {src.BARS} SELECT b.asset_id, b.ts, e.ts AS exit_ts, round(e.close / n.open - 1, 6) + 0.0::DOUBLE AS forward_return FROM bars b JOIN bars n ON n.asset_id = b.asset_id AND n.seq = b.seq + 1
JOIN bars m ON m.asset_id = b.asset_id AND m.seq = b.seq + 2 JOIN bars e ON e.asset_id = b.asset_id AND e.seq = b.seq + 3""")
def j12(spark, sf):
    l = market.forward_labels(src.bars(spark, sf), 3).where("forward_return is not null")
    return rounded(l.select("asset_id", "ts", F.col("label_end").alias("exit_ts"), "forward_return"))


@query("J16_near_pairs", f"""WITH {PRE}, k AS (SELECT min(doc_id) AS id, list_distinct(tokens) AS s FROM pre WHERE len(tokens) > 0 GROUP BY tokens),
j AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.s, y.s))::DOUBLE AS n, len(x.s) + len(y.s) AS total FROM k x JOIN k y ON x.id < y.id AND least(len(x.s), len(y.s)) >= 0.8 * greatest(len(x.s), len(y.s)))
SELECT a, b, round(n / (total - n), 6) AS similarity FROM j WHERE n / (total - n) >= 0.82""")
def j16(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.preprocess("text").getField("tokens").alias("toks")).where(F.size("toks") > 0)
    return rounded(textops.duplicate_pairs(d, 0.82, ratio=False, copies=False))


@query("J23_provenance", """WITH m AS (SELECT page_id, sha256(html) AS h FROM pages), g AS (SELECT page_id, sha256(CASE WHEN page_id % 10 = 0 THEN html || ' ' ELSE html END) AS h FROM pages WHERE page_id % 7 <> 0)
SELECT m.page_id, CASE WHEN g.page_id IS NULL THEN 'missing' WHEN g.h <> m.h THEN 'changed' ELSE 'bound' END AS status FROM m LEFT JOIN g USING (page_id) WHERE m.h IS NOT NULL""")
def j23(spark, sf):
    p = t(spark, sf, "pages").where("html is not null")
    claimed = p.select("page_id", F.sha2("html", 256).alias("h"))
    found = p.where(F.col("page_id") % 7 != 0).select("page_id", F.sha2(F.when(F.col("page_id") % 10 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")), 256).alias("h"))
    return joins.provenance(claimed, found, "page_id", "h")


@query("U02_key_sets", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_left, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_right""")
def u02(spark, sf):
    o = t(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O")).groupBy(F.col("o_custkey").alias("k")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("l"), F.bool_or(F.col("o_orderstatus") == "O").alias("r"))
    return o.agg(F.count_if(F.col("l") & ~F.col("r")).alias("only_left"), F.count_if(F.col("r") & ~F.col("l")).alias("only_right"))


@query("T01_final_order", f"WITH {src.BARS} SELECT asset_id, ts, row_number() OVER (PARTITION BY ts ORDER BY asset_id)::INTEGER AS position FROM bars")
def t01(spark, sf):
    return src.bars(spark, sf).select("asset_id", "ts", F.row_number().over(Window.partitionBy("ts").orderBy("asset_id")).alias("position"))


@query("T06_recent_candidates", f"WITH {src.SIGNALS} SELECT author, item_id FROM signals QUALIFY row_number() OVER (PARTITION BY author ORDER BY available_at DESC, item_id DESC) <= 4")
def t06(spark, sf):
    return textops.recent_candidates(src.signals(spark, sf), "author", "available_at", "item_id", 4).select("author", "item_id")


@query("C03_similarity", f"""WITH k AS (SELECT doc_id, list_distinct({TOKS}) AS s FROM documents)
SELECT x.doc_id, round(CASE WHEN len(x.s) + len(y.s) = 0 THEN 1.0 ELSE len(list_intersect(x.s, y.s))::DOUBLE / len(list_distinct(list_concat(x.s, y.s))) END, 6)::DOUBLE AS jaccard FROM k x JOIN (SELECT doc_id, lead(doc_id) OVER (ORDER BY doc_id) AS after FROM (SELECT DISTINCT doc_id FROM k)) n ON n.doc_id = x.doc_id JOIN k y ON y.doc_id = n.after""")
def c03(spark, sf):
    k = t(spark, sf, "documents").select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("s"))
    return rounded(joins.following(k, "doc_id", "s").select("doc_id", T.jaccard(F.col("s"), F.col("next")).alias("jaccard")))


@query("C19_holding_days", "SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate::DATE > o_orderdate::DATE THEN (l_shipdate::DATE - o_orderdate::DATE)::DOUBLE END AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def c19(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    l = t(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return l.select("l_orderkey", "l_linenumber", core.holding_days(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")).alias("days"))


@query("C21_math", f"WITH {src.BARS} SELECT asset_id, ts, round(sqrt(close), 6) AS root, round(ln(1 + volume), 6) AS log_volume, round(exp(-volume / 1000), 6) + 0.0::DOUBLE AS decay, round(power(abs(close - open), 0.5), 6) AS power FROM bars")
def c21(spark, sf):
    b = src.bars(spark, sf)
    return rounded(b.select("asset_id", "ts", F.sqrt("close").alias("root"), F.log1p("volume").alias("log_volume"), F.exp(-F.col("volume") / 1000).alias("decay"), F.pow(F.abs(F.col("close") - F.col("open")), F.lit(0.5)).alias("power")))


@query("C26_signed_label", "SELECT doc_id, CASE WHEN quality = 1 THEN 0.75 WHEN toxic = 1 THEN -0.75 ELSE 0.0 END::DOUBLE AS score FROM labels")
def c26(spark, sf):
    name = F.when(F.col("quality") == 1, " Positive").when(F.col("toxic") == 1, "NEGATIVE").otherwise("neutral")
    return t(spark, sf, "labels").select("doc_id", core.signed_label(name, F.lit(0.75)).alias("score"))


@query("C27_forbidden_text", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(coalesce(text, '')), 'password|api[_ -]?key|secret|@[a-z0-9.-]+\.example')")
def c27(spark, sf):
    return t(spark, sf, "documents").where(F.lower("text").rlike(r"password|api[_ -]?key|secret|@[a-z0-9.-]+\.example")).select("doc_id")


@query("C28_annotation_request", f"""WITH k AS (SELECT conv_id, turn, text, list_sort(list_distinct({TOKS})) AS w FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, sha256(to_json({{'candidates': w, 'text_sha256': sha256(text)}})::VARCHAR) AS request_id, len(w)::INTEGER AS candidates FROM k""")
def c28(spark, sf):
    c = t(spark, sf, "conversations").where("text is not null").withColumn("w", F.array_sort(F.array_distinct(T.tokens(F.col("text")))))
    body = F.to_json(F.struct(F.col("w").alias("candidates"), F.sha2("text", 256).alias("text_sha256")))
    return c.select("conv_id", "turn", F.sha2(body, 256).alias("request_id"), F.size("w").alias("candidates"))


@query("B03_seen_ids", "SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS seen FROM orders")
def b03(spark, sf):
    seen = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_s", F.lit(True))
    return t(spark, sf, "orders").select("o_orderkey").join(seen, "o_orderkey", "left").select("o_orderkey", F.coalesce("_s", F.lit(False)).alias("seen"))


_ROWS = (("quantity", "l_quantity <= 0 OR l_quantity <> floor(l_quantity)"), ("discount", "l_discount < 0 OR l_discount > 0.08"), ("flag", "l_returnflag NOT IN ('A', 'N')"), ("status", "l_linestatus NOT IN ('O', 'F')"))


@query("B06_row_contract", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {flags(*_ROWS)} AS broken FROM lineitem")
def b06(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(core.rule_flags(*((n, F.expr(c)) for n, c in _ROWS)), ",").alias("broken"))


@query("B09_intent_digest", "SELECT o_orderkey, sha256(to_json({'account': o_custkey, 'order': o_orderkey, 'side': o_orderstatus})::VARCHAR) AS digest FROM orders")
def b09(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", broker.intent_digest(side=F.col("o_orderstatus"), account=F.col("o_custkey"), order=F.col("o_orderkey")).alias("digest"))


_CHECKS = (("no_text", "text IS NULL OR length(trim(text)) = 0"), ("no_role", "role IS NULL"), ("unknown_role", "role NOT IN ('user', 'assistant', 'system')"), ("negative_turn", "turn < 0"), ("too_long", "length(text) > 400"), ("first_not_user", "turn = 0 AND role <> 'user'"))


@query("G13_annotation_checks", f"SELECT conv_id, turn, {flags(*_CHECKS)} AS failed FROM conversations")
def g13(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", F.array_join(core.rule_flags(*((n, F.expr(c)) for n, c in _CHECKS)), ",").alias("failed"))


@query("G16_batched_inference", "SELECT doc_id, length(text)::DOUBLE / 1000 AS score FROM documents WHERE text IS NOT NULL")
def g16(spark, sf):
    rows = t(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    return inference.predict_batches(rows, "text", lambda: lambda s: s.str.len() / 1000.0, "score", "double").select("doc_id", "score")


@query("S01_record_formats", "SELECT format, n_nationkey, n_name, n_regionkey FROM nation, (SELECT unnest(['csv', 'jsonl', 'parquet']) AS format)")
def s01(spark, sf):
    """The same records through CSV, JSON lines and Parquet, read with one schema."""
    n, at, out = t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), _folder(spark), None
    schema = ", ".join(f"{c} {k}" for c, k in n.dtypes)
    for kind in ("csv", "jsonl", "parquet"):
        w = n.write.option("header", True)
        w.csv(f"{at}/n.csv") if kind == "csv" else w.json(f"{at}/n.jsonl") if kind == "jsonl" else w.parquet(f"{at}/n.parquet")
        part = readers.read_records(spark, f"{at}/n.{kind}", schema).select(F.lit(kind).alias("format"), *n.columns)
        out = part if out is None else out.unionByName(part)
    return out


@query("S11_record_dicts", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def s11(spark, sf):
    """Records to JSON text and back."""
    p = t(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return p.select(F.from_json(F.to_json(F.struct(*p.columns)), p.schema).alias("x")).select("x.*")


@query("S14_schema_merge", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::DOUBLE ELSE c_acctbal END AS v, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS segment FROM customer")
def s14(spark, sf):
    c, at = t(spark, sf, "customer"), _folder(spark)
    c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_nationkey").alias("v")).write.parquet(f"{at}/a")
    c.where("c_custkey % 2 = 1").select("c_custkey", F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("segment")).write.parquet(f"{at}/b")
    return readers.merged(spark, [f"{at}/a", f"{at}/b"])


@query("S15_content_store", "SELECT sha256(html) AS sha256, length(html) AS length, min(page_id) AS first, count(*) AS copies FROM pages WHERE html IS NOT NULL GROUP BY ALL")
def s15(spark, sf):
    return stores.content_addressed(t(spark, sf, "pages"), "html", "page_id")


@query("S17_feature_store", f"WITH {src.BARS} SELECT asset_id, ts AS asof_ts, round(close, 6) AS close FROM bars WHERE ts BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def s17(spark, sf):
    """Appended in two parts, then read by version and time."""
    b = src.bars(spark, sf).select("asset_id", F.col("ts").alias("asof_ts"), F.lit("1d").alias("horizon"), F.lit("v1").alias("feature_set_version"), "close")
    store = stores.FeatureStore(spark, _folder(spark))
    store.append(b.where("asof_ts < date'1995-06-01'"))
    store.append(b.where("asof_ts >= date'1995-06-01'"))
    return rounded(store.read("v1", start=date(1995, 1, 1), end=date(1995, 12, 31)).select("asset_id", "asof_ts", "close"))


_U = "('0x' || substr(sha256('7:' || a || ':' || s{}), 1, 8))::BIGINT / 4294967296.0"


@query("S21_synthetic_paths", f"""WITH g AS (SELECT a, s, ({_U.format('')} - 0.5) * 0.04 AS move, {_U.format(" || ':w'")} * 0.01 AS w FROM range((SELECT count(*) FROM supplier)) x(a), range(200) y(s)),
p AS (SELECT *, 100 * exp(sum(move) OVER (PARTITION BY a ORDER BY s)) AS c FROM g), o AS (SELECT *, c / exp(move) AS o FROM p)
SELECT a AS asset, s AS session, round(o, 6) AS open, round(greatest(o, c) * (1 + w), 6) AS high, round(least(o, c) * (1 - w), 6) AS low, round(c, 6) AS close FROM o""")
def s21(spark, sf):
    """A path of 200 sessions for each supplier."""
    return rounded(synthetic.price_paths(spark, t(spark, sf, "supplier").count(), 200, 7))


@query("S22_evidence_bundle", "SELECT 'benchmark' AS name, count(*) AS n FROM benchmark UNION ALL SELECT 'conversations', count(*) FROM conversations")
def s22(spark, sf):
    """Written with a manifest of row hashes, then loaded and held against it."""
    at = _folder(spark)
    stores.write_bundle({n: t(spark, sf, n) for n in ("benchmark", "conversations")}, at)
    out = None
    for name, df in stores.load_bundle(spark, at).items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
