import hashlib
import math
import random
from datetime import date, datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.functions import text as T
from tidemark.operators import joins, ledger, models, portfolio, quality
from tidemark.operators import text as ops
from tidemark.sources import readers, stores
from tidemark.streaming import windows


def test_readers_and_merge(spark, tmp_path):
    (tmp_path / "a.csv").write_text("asset_id,symbol,active_from,short_available\nA,AAA,2020-01-02,yes\nB,BBB,,no\n")
    r = {x.asset_id: x for x in readers.assets(spark, str(tmp_path / "a.csv")).collect()}
    assert r["A"].short_available and not r["A"].hard_to_borrow and r["A"].active_from == date(2020, 1, 2)
    assert r["B"].hard_to_borrow and r["B"].active_from is None
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_records(spark, str(tmp_path / "x.json")).count() == 2 and readers.read_records(spark, str(tmp_path / "x.jsonl")).count() == 2
    with pytest.raises(ValueError):
        readers.read_records(spark, "x.xlsx")
    spark.createDataFrame([(1, None)], "k long, v int").select("k", F.lit(None).cast("int").alias("v")).write.parquet(str(tmp_path / "p1"))
    spark.createDataFrame([(2, 1.25, "z")], "k long, v double, w string").write.parquet(str(tmp_path / "p2"))
    m = readers.merged(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")])
    assert sorted(map(tuple, m.collect())) == [(1, None, None), (2, 1.25, "z")]


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("A/1", datetime(2026, 1, 2), "1d", "v1", 1.0, [1, 2])], "asset_id string, asof_ts timestamp, horizon string, feature_set_version string, f double, n array<int>")
    stores.write_partitioned(rows, str(tmp_path / "p"), ["asset_id"])
    back = spark.read.parquet(str(tmp_path / "p")).first()
    assert back.asset_id == "A_1" and back.n == "[1,2]"
    s = stores.FeatureStore(spark, str(tmp_path / "store"))
    s.append(rows)
    with pytest.raises(ValueError):
        s.append(rows)
    assert s.read("v1", ["A/1"]).count() == 1 and s.read("v2").count() == 0
    m = stores.blob_manifest(spark, str(tmp_path / "p"))
    assert len(stores.tree_digest(m, "file:" + str(tmp_path / "p"))) == 64
    assert stores.canonical_json({"b": 1, "a": [1.5]}) == '{"a":[1.5],"b":1}'
    assert stores.strict_json('{"a": [1, {"b": null}]}') == {"a": [1, {"b": None}]}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', "[-Infinity]", "{"):
        with pytest.raises(ValueError):
            stores.strict_json(bad)
    assert "- a.b: 1" in stores.report("t", {"a": {"b": 1}}, rows.select("asset_id"))


def test_asof_and_ranges(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1)], "k string, at long")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), ("b", 2, "z")], "k string, t long, v string")
    assert sorted(map(tuple, joins.asof_backward(left, right, ["k"], "at", "t", ["v"]).collect()), key=str) == [("a", 10, "y"), ("a", 5, "x"), ("b", 1, None)]
    assert sorted(map(tuple, joins.asof_forward(left, right, ["k"], "at", "t", ["v"]).collect()), key=str) == [("a", 10, None), ("a", 5, "y"), ("b", 1, "z")]
    assert sorted(map(tuple, joins.asof_forward(left, right, ["k"], "at", "t", ["v"], strict=False).collect()), key=str) == [("a", 10, None), ("a", 5, "x"), ("b", 1, "z")]
    pairs = joins.range_join(left, right, ["k"], "at", "t", 5).select("at", "t").collect()
    assert sorted(map(tuple, pairs)) == [(5, 5), (10, 7)]  # left-open, right-closed


def test_portfolio_limits(spark):
    rows = spark.createDataFrame([("a", "d", 3.0, "Tech", 2.0, 1e6, 50.0), ("b", "d", 2.0, "Tech", 1.0, 1e6, 50.0), ("c", "d", -1.0, " ", 1.0, 1e4, 50.0)],
                                 "asset_id string, ts string, score double, sector string, beta double, dollar_volume double, close double")
    lim = portfolio.Limits()
    book = portfolio.constrain(portfolio.top_k(rows, 3, ["ts"], lim), ["ts"], lim, 1e6)
    e = portfolio.exposures(book, ["ts"]).first()
    assert e.gross <= lim.max_gross_exposure + 1e-9 and abs(e.net) <= lim.max_net_exposure + 1e-9 and abs(e.beta) <= lim.max_beta_exposure + 1e-9
    assert all(v <= lim.max_sector_weight + 1e-9 for v in e.sectors.values()) and "UNKNOWN" in e.sectors
    assert all(r.participation <= lim.max_participation_rate + 1e-9 for r in book.collect())


def test_precision_ties_and_metrics(spark):
    rows = spark.createDataFrame([("d", 1.0, 0.1), ("d", 1.0, -0.1)], "ts string, score double, y double")
    assert models.precision_at_k(rows, ["ts"], 1).first().precision == 0.5
    p = spark.createDataFrame([(0.8, 1), (0.2, 0), (0.8, 1), (0.2, 0)], "p double, y int")
    c = models.classification(p, 10).first()
    assert math.isclose(c.brier, 0.04) and math.isclose(c.ece, 0.2)


ITEMS = [(1, "alpha raises full year guidance after strong demand"), (2, "alpha raises full year guidance after very strong demand"), (3, "alpha raises full year guidance after strong demand"),
         (4, "beta faces a product recall in europe"), (5, "xx"), (6, "")]


def items(spark):
    return spark.createDataFrame(ITEMS, "id long, text string").withColumn("toks", T.tokens(F.col("text")))


def plain_clusters(threshold=0.82):
    def near(a, b):
        a, b = a.split(), b.split()
        if a == b:
            return True
        return bool(a and b) and max(len(set(a) & set(b)) / len(set(a) | set(b)), SequenceMatcher(None, a, b, autojunk=False).ratio()) >= threshold
    root = {i: i for i, _ in ITEMS}
    for i, a in ITEMS:
        for j, b in ITEMS:
            if i < j and near(a, b):
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    return root


def test_duplicate_clusters(spark):
    got = {r.id: r.cluster_id for r in ops.clusters(items(spark)).collect()}
    want = plain_clusters()
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in got for j in got) and set(got) == set(want)
    later = {r.id: r.cluster_id for r in ops.incremental_clusters(items(spark)).collect()}
    assert set(later) == set(want) and later[1] == later[2] == later[3] != later[4]


def test_entity_linking(spark):
    assets = spark.createDataFrame([("1", "ABC", "Alpha Beta"), ("2", "ABC", "Gamma"), ("3", "XYZ", "Delta Works"), ("4", "IT", "Info Tech")], "asset_id string, symbol string, name string")
    it = spark.createDataFrame([(1, "Alpha Beta rises", "ABC up"), (2, "news", "$XYZ and alphabeta"), (3, "IT spending ABC", "none")], "item_id long, title string, body string")
    got = {(r.item_id, r.asset_id): (r.relevance, r.mention_type) for r in ops.link_entities(it, assets).collect()}
    assert got == {(1, "1"): (1.0, "primary"), (2, "3"): (0.9, "primary")}


def test_search(spark):
    docs = spark.createDataFrame([(1, "need improvement soon"), (2, "all is fine"), (3, "no improvement")], "id long, text string")
    q = spark.createDataFrame([(7, "improvement")], "query_id long, text string")
    got = ops.search(docs, q, F.col("id") != 2).orderBy("rank").collect()
    assert [r.id for r in got] == [3, 1] and got[0].score > got[1].score


def test_ledger_and_quality(spark):
    e = spark.createDataFrame([(1, 0, "open"), (1, 1, "close"), (2, 0, "close")], "k long, seq long, kind string")
    log = ledger.chained(e, ["k"], "seq", F.concat_ws(":", "k", "seq", "kind"))
    assert ledger.verify_chain(log, ["k"], "seq", F.concat_ws(":", "k", "seq", "kind")).count() == 0
    broken = log.withColumn("kind", F.when(F.col("seq") == 1, "x").otherwise(F.col("kind")))
    assert ledger.verify_chain(broken, ["k"], "seq", F.concat_ws(":", "k", "seq", "kind")).first().broken == ["content"]
    f = {r.k: (r.state, r.n_invalid) for r in ledger.fold(e, ["k"], "seq", "kind", {("new", "open"): "live", ("live", "close"): "done"}, "new").collect()}
    assert f == {1: ("done", 0), 2: ("new", 1)}
    assert {r.k for r in ledger.unresolved(e, ["k"], ["seq"], "kind", ["close"]).collect()} == {1, 2}
    with pytest.raises(quality.QualityError):
        quality.assert_empty(quality.duplicates(e, ["k"]), "duplicate")
    late = spark.createDataFrame([(datetime(2026, 1, 1), datetime(2026, 1, 2), [datetime(2025, 1, 1)]), (datetime(2026, 1, 3), None, [datetime(2027, 1, 1)])], "asof_ts timestamp, a_available_at timestamp, input_available_at array<timestamp>")
    assert quality.future_inputs(late).count() == 2


def test_streaming(spark, tmp_path):
    rows = [("a", datetime(2026, 1, 1, 10), 1.0), ("a", datetime(2026, 1, 2, 10), -1.0), ("b", datetime(2026, 1, 2, 12), 0.5)]
    spark.createDataFrame(rows, "asset_id string, available_at timestamp, sentiment double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("asset_id string, available_at timestamp, sentiment double").parquet(str(tmp_path / "in"))
    windows.attention(s).writeStream.format("memory").queryName("att").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(60)
    got = {(r.asset_id, r.window.start.day, r.window.start.month): r.n for r in spark.table("att").collect()}
    assert got["a", 1, 1] == 2 and got["a", 2, 1] == 1 and got["b", 2, 1] == 1
    spark.createDataFrame([(1, 0, "open"), (1, 1, "close"), (2, 0, "open")], "k long, seq long, kind string").coalesce(1).write.parquet(str(tmp_path / "ev"))
    e = spark.readStream.schema("k long, seq long, kind string").parquet(str(tmp_path / "ev"))
    f = windows.fold(e, "k", "kind", {("new", "open"): "live", ("live", "close"): "done"}, "new")
    f.writeStream.format("memory").queryName("fold").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(60)
    assert {(r.k, r.state, r.n_events) for r in spark.table("fold").collect()} == {(1, "done", 2), (2, "live", 1)}


@pytest.mark.parametrize(("threshold", "ratio"), [(0.82, True), (0.5, True), (0.5, False)])
def test_duplicate_pairs_are_all_pairs(spark, threshold, ratio):
    rng = random.Random(23)
    texts = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 14))] for _ in range(50)]
    for t in texts[:30]:
        texts.append(rng.sample(t, len(t)))  # another order
        texts.append([rng.choice("xyz") if rng.random() < 0.25 else w for w in t] + t[:rng.randrange(3)])
    texts.append([])
    rows = list({tuple(t): i for i, t in enumerate(texts)}.items())
    got = {(r.a, r.b): r.similarity for r in ops.duplicate_pairs(spark.createDataFrame([(i, list(t)) for t, i in rows], "id long, toks array<string>"), threshold, ratio).collect()}
    want = {}
    for s, i in rows:
        for t, j in rows:
            if i < j and s and t:
                x = len({*s} & {*t}) / len({*s} | {*t})
                x = max(x, SequenceMatcher(None, s, t, autojunk=False).ratio()) if ratio else x
                if x >= threshold:
                    want[i, j] = x
    assert set(got) == set(want) and (len(want) > 30)


@pytest.mark.parametrize("days", [3, 40, 5000])
@pytest.mark.parametrize("kind", ["long", "date"])
def test_asof_joins_over_buckets(spark, days, kind):
    rng = random.Random(days)
    left = [(rng.choice("ab"), rng.randrange(-300, 300), i) for i in range(120)]
    right = [(rng.choice("aac"), rng.randrange(-250, 250), i, rng.randrange(3)) for i in range(60)]
    at = (lambda c: c) if kind == "long" else (lambda c: F.date_add(F.lit("2000-01-01").cast("date"), c.cast("int")))
    l = spark.createDataFrame(left, "k string, at long, i long").withColumn("at", at(F.col("at")))
    r = spark.createDataFrame(right, "k string, t long, v long, o long").withColumn("t", at(F.col("t")))
    got = {x.i: x.v for x in joins.asof_backward(l, r, ["k"], "at", "t", ["v"], ["o", "v"], days=days).collect()}
    best = lambda rows, order: (min if order < 0 else max)(rows, key=lambda x: (x[1], x[3], x[2]))[2] if rows else None
    assert got == {i: best([x for x in right if x[0] == k and x[1] <= a], 1) for k, a, i in left}
    for strict in (True, False):
        got = {x.i: x.v for x in joins.asof_forward(l, r, ["k"], "at", "t", ["v"], strict, days).collect()}
        for k, a, i in left:
            after = [x for x in right if x[0] == k and (x[1] > a if strict else x[1] >= a)]
            assert got[i] in ([x[2] for x in after if x[1] == min(y[1] for y in after)] if after else [None])


def test_incremental_clusters_follow_the_order(spark):
    rng = random.Random(31)
    texts = [" ".join(rng.choice("abcdefghijkl") for _ in range(12)) for _ in range(6)]
    for _ in range(60):
        t = rng.choice(texts).split()
        t[rng.randrange(len(t))] = rng.choice("mnopqrst")
        texts.append(" ".join(t))
    got = {r.id: r.cluster_id for r in ops.incremental_clusters(spark.createDataFrame([(i, t, t.split()) for i, t in enumerate(texts)], "id long, text string, toks array<string>")).collect()}
    want: dict = {}
    for i, t in enumerate(texts):
        near = []
        for j in range(i):
            a, b = texts[j].split(), t.split()
            x = 1.0 if a == b else max(len({*a} & {*b}) / len({*a} | {*b}), SequenceMatcher(None, a, b, autojunk=False).ratio())
            if x >= 0.82:
                near.append((-x, want[j]))
        want[i] = min(near)[1] if near else "text-" + hashlib.sha256(t.encode()).hexdigest()[:16]
    assert got == want and len(set(got.values())) < 40


def test_text_signals(spark):
    assets = spark.createDataFrame([("1", "ABC", "Alpha Beta Inc", None), ("2", "XYZ", "Delta Works", date(2026, 1, 3))], "asset_id string, symbol string, name string, active_to date")
    rows = [(1, date(2026, 1, 1), "news", "Alpha Beta beats", "strong growth, upgraded https://a.b https://c.d"), (2, date(2026, 1, 2), "blog", "Alpha Beta beats", "strong growth, upgraded https://a.b https://c.d"),
            (3, date(2026, 1, 2), "?", None, "$XYZ warned of a lawsuit"), (4, date(2026, 1, 4), "news", None, "$XYZ declined again")]
    items = spark.createDataFrame(rows, "item_id long, at date, source_type string, title string, body string").withColumn("on", F.col("at"))
    got = {(r.item_id, r.asset_id): r for r in ops.text_signals(items, assets).collect()}
    assert set(got) == {(1, "1"), (2, "1"), (3, "2")}  # the second asset has gone by the fourth item
    assert [got[k].novelty for k in sorted(got)] == [1.0, 0.0, 1.0] and got[1, "1"].duplicate_cluster_id == got[2, "1"].duplicate_cluster_id
    assert got[1, "1"].sentiment_label == "positive" and got[3, "2"].sentiment_label == "negative" and got[3, "2"].event_type == "litigation"
    assert got[1, "1"].spam_score == 0.1 and got[2, "1"].source_credibility == 0.6 and got[3, "2"].source_credibility == 0.5 and got[1, "1"].relevance == 1.0


def test_name_aliases_and_edges(spark):
    df = spark.createDataFrame([("alpha beta inc",), ("abcd inc",), ("gamma",), ("a+b (c)",)], "n string").withColumn("a", T.name_aliases(F.col("n")))
    assert [r.a for r in df.collect()] == [["alpha beta inc", "alpha beta"], ["abcd inc"], ["gamma"], ["a+b (c)"]]
    got = df.select(T.names_any(F.lit("xx alpha beta, gammas a+b (c)"), F.col("a")).alias("h")).collect()
    assert [r.h for r in got] == [True, False, False, True]


def test_prediction_metrics_and_segments(spark):
    rows = [("d1", 1.0, 0.1, 0.2, ["x", "y"]), ("d1", 1.0, -0.1, 0.0, ["x"]), ("d1", 0.5, 0.3, 0.1, []), ("d2", 2.0, 0.5, 0.5, ["y"])]
    df = spark.createDataFrame(rows, "ts string, score double, y double, expected double, tags array<string>")
    m = models.prediction_metrics(df.withColumn("g", F.lit("all")), ["g"], "ts", 2).first()
    assert (m["rows"], m.dates, m.ic_dates) == (4, 2, 1) and m.hit_rate == 0.75 and math.isclose(m.mean_squared_error, (0.01 + 0.01 + 0.04) / 4)
    assert m.precision_at_k == (1 + 0.5) / 2 and m.mean_daily_precision_at_k == (0.5 + 1) / 2
    got = {r.segment: r["count"] for r in models.segments(df, {"day": F.col("ts"), "tag": F.col("tags")}).groupBy("segment").count().collect()}
    assert got == {"day: d1": 3, "day: d2": 1, "tag: x": 2, "tag: y": 2}


def test_fold_in_stretches(spark):
    rng = random.Random(41)
    moves = {("new", "open"): "live", ("live", "fill"): "part", ("part", "fill"): "done", ("live", "stop"): "gone", ("part", "stop"): "gone", ("gone", "open"): "live"}
    rows = [(k, i, rng.choice(["open", "fill", "stop", "?"])) for k in range(5) for i in range(rng.randrange(0, 90))]
    got = {r.k: (r.state, r.n_events, r.n_invalid) for r in ledger.fold(spark.createDataFrame(rows, "k long, seq long, kind string").repartition(3), ["k"], "seq", "kind", moves, "new", chunk=7).collect()}
    want: dict = {}
    for k, _, e in rows:
        state, n, bad = want.get(k, ("new", 0, 0))
        want[k] = (moves.get((state, e), state), n + 1, bad + ((state, e) not in moves))
    assert got == want


def test_overlapping_intervals_over_buckets(spark):
    rng = random.Random(42)
    rows = [(i, rng.choice("ab"), rng.randrange(300), rng.sample(range(6), rng.randrange(1, 3))) for i in range(80)]
    rows = [(i, k, date.fromordinal(730000 + a), date.fromordinal(730000 + a + rng.randrange(-2, 90)), m) for i, k, a, m in rows]
    df = spark.createDataFrame(rows, "i int, k string, a date, b date, m array<int>")
    got = [(r.i_l, r.i_r) for r in joins.overlapping(df, df, ["k"], "a", "b", "m", days=10).where("i_l < i_r").collect()]
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3] and {*x[4]} & {*y[4]}}
    assert len(got) == len(set(got)) and set(got) == want


def test_overlapping_intervals_of_a_century(spark):
    """Long and short ones, before 1970 too, of two tables: each pair once, few blocks an interval."""
    rng = random.Random(7)
    make = lambda n: [(i, rng.choice("ab"), a := rng.randrange(600_000, 740_000), a + rng.choice([-1, 0, 3, 63, 64, 65, 900, 36_524, 70_000])) for i in range(n)]
    x, y = make(150), make(120) + [(900, "a", 600_000, 700_000), (901, "a", 700_000, 700_000)]
    frame = lambda rows: spark.createDataFrame([(i, k, date.fromordinal(a), date.fromordinal(b)) for i, k, a, b in rows] + [(-1, "a", None, None)], "i int, k string, a date, b date")
    got = [(r.i_l, r.i_r) for r in joins.overlapping(frame(x), frame(y), ["k"], "a", "b").collect()]
    want = {(p[0], q[0]) for p in x for q in y if p[1] == q[1] and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3]}
    assert len(got) == len(set(got)) and set(got) == want
    assert joins.overlapping(frame([]), frame(y), ["k"], "a", "b").count() == 0


def _joined(plan):
    """Rows that the joins of an executed plan gave out."""
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan.plan() if "QueryStage" in plan.nodeName() else plan
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    return own + sum(_joined(plan.children().apply(i)) for i in range(plan.children().size()))


def _holdouts(spark, path, n, seed):
    """Orders of one lineage, target and contract, some twice or with nulls; keys of parts below zero too."""
    rng = random.Random(seed)
    orders = [(k, 100 * (k % 7), "O", "1" if k % 31 else None, date.fromordinal(730_000 + rng.randrange(900))) for k in range(n)]
    lines = [(k, rng.randrange(-60, 200), a + timedelta(rng.choice([-3, 0, 1, 90, 700]))) for k, *_, a in orders for _ in range(rng.randrange(0, 4))]
    spark.createDataFrame(orders + orders[:20], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate date").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines + [(5, None, date.fromordinal(731_000))], "l_orderkey long, l_partkey long, l_shipdate date").write.parquet(f"{path}/lineitem.parquet")
    end, parts = {}, {}
    for k, p, b in [*lines, (5, None, date.fromordinal(731_000))]:
        end[k] = max(end.get(k, b), b)
        parts.setdefault(k, set()).update([] if p is None else [p % 40 if p >= 0 else -(-p % 40)])
    rows = [(k, a, end[k], parts[k]) for k, _, _, c, a in orders if c and k in end and a <= end[k]]
    return {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] <= y[2] and y[1] <= x[2] and x[3] & y[3]}


def test_holdouts_of_one_lineage_are_joined_as_chunks(spark, tmp_path):
    want = _holdouts(spark, tmp_path, 2000, 5)
    df = plans.QUERIES["J18_interval_overlap"](spark, str(tmp_path))
    got = [(r.k1, r.k2) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20_000
    assert _joined(df._jdf.queryExecution().executedPlan()) < 15_000  # rows and chunks, not pairs


def test_holdouts_in_many_chunks_and_parts(spark, tmp_path, monkeypatch):
    for name, value in (("CHUNK", 4), ("PART", 8), ("PAIRS", 100)):
        monkeypatch.setattr(joins, name, value)
    want = _holdouts(spark, tmp_path, 200, 6)
    got = [(r.k1, r.k2) for r in plans.QUERIES["J18_interval_overlap"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_pages_follow_sound_cursors_only(spark):
    ranked = spark.createDataFrame([(q, r, 100 * q + r) for q in (1, 2) for r in range(1, 6)], "query_id long, rank int, id long")
    first = ops.page(ranked, spark.createDataFrame([(1, None), (2, None)], "query_id long, cursor string"), "ix", 2)
    cursors = {r.query_id: r.next_cursor for r in first.where("rank = 2").collect()}
    assert first.count() == 4
    seen = lambda c, index="ix": [(r.query_id, r["rank"], r.next_cursor is None) for r in ops.page(ranked, spark.createDataFrame(c, "query_id long, cursor string"), index, 2).orderBy("query_id", "rank").collect()]
    assert seen([(1, cursors[1]), (2, cursors[2])]) == [(1, 3, False), (1, 4, False), (2, 3, False), (2, 4, False)]
    assert seen([(1, cursors[2])]) == [] and seen([(1, cursors[1])], "other") == [] and seen([(1, cursors[1][:-4] + "abcd")]) == [] and seen([(1, "no cursor")]) == []
    assert ops.page(ranked.withColumn("id", F.col("id") + 1), spark.createDataFrame([(1, cursors[1])], "query_id long, cursor string"), "ix", 2).count() == 0


def test_numbers_and_annotations(spark):
    df = spark.createDataFrame([("up 5%, -3.5 and .5; v2.0, 1.2.3, x4 +7", "5% -3.5 7")], "a string, b string")
    r = df.select(T.numeric_tokens(F.col("a")).alias("n"), T.ungrounded(F.array("a"), F.array("b")).alias("u")).first()
    assert r.n == ["5%", "-3.5", ".5", "+7"] and sorted(r.u) == ["+7", ".5"]


def test_sketches_leave_no_similar_pair_out(spark):
    """Items of the same few words share rare ones throughout: similar pairs are all candidates, most others are not."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(90)]
    rows = [rng.choices(words, k=60) for _ in range(40)]
    rows += [r[:k] + ["new"] * (k % 7) + r[k:] for r in rows[:20] for k in (30, 55)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, toks array<string>")
    similar = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if SequenceMatcher(None, rows[a], rows[b], autojunk=False).ratio() >= 0.82}
    found = {(r.a, r.b) for r in ops.candidates(df, 0.82, True).collect()}
    assert len(similar) >= 40 and similar <= found and len(found) < 2 * len(similar)
    s = ops.sketches(df)
    near = s.select(F.col("id").alias("a"), F.col("sketch").alias("x")).join(s.select(F.col("id").alias("b"), F.col("sketch").alias("y")), F.col("a") < F.col("b")).where(ops.reachable("x", "y", 0.82))
    near = {(r.a, r.b) for r in near.select("a", "b").collect()}
    assert similar <= near and len(near) < 2 * len(similar)


def test_large_items_are_pruned_before_their_tokens_travel(spark):
    """Items of many tokens that share their words, but too few of them, are no candidates."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(1500)]
    rows = [rng.choices(words, k=3000) for _ in range(60)]
    rows += [r[:2900] + ["new"] * 100 for r in rows[:5]]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, toks array<string>")
    found = {(r.a, r.b) for r in ops.candidates(df, 0.82, True).collect()}
    assert {(i, 60 + i) for i in range(5)} <= found and len(found) < 20


def test_elements_of_many_items_are_met_in_cells(spark, monkeypatch):
    monkeypatch.setattr(ops, "GROUP", 4)
    monkeypatch.setattr(ops, "LOOK", 7)
    rng = random.Random(10)
    base = [f"w{i}" for i in range(40)]
    rows = [[f"x{rng.randrange(30)}" if rng.random() < 0.04 else w for w in base] for _ in range(50)]
    df = spark.createDataFrame([(3 * i, r) for i, r in enumerate(rows)], "id long, toks array<string>").repartition(3)
    near = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.82
    want = {(3 * i, 3 * j) for i in range(50) for j in range(i + 1, 50) if near(rows[i], rows[j]) and rows[i] != rows[j]}
    found = [(r.a, r.b) for r in ops.duplicate_pairs(df, 0.82, ratio=False, copies=False).collect()]
    firsts = {tuple(r): 3 * i for i, r in reversed(list(enumerate(rows)))}
    want = {(a, b) for a, b in want if a in firsts.values() and b in firsts.values()}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 300
