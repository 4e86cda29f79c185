from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import core
from tidemark.operators import inference, joins, models, portfolio, quality, text
from tidemark.plans import QUERIES
from tidemark.sources import readers, stores, synthetic


def test_utc_text_drops_zero_microseconds(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05' AS a, timestamp_ntz'2024-01-02 03:04:05.000120' AS b, cast(null as timestamp_ntz) AS c")
    assert tuple(df.select(*(core.format_utc(F.col(c)) for c in "abc")).first()) == ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05.000120Z", None)


def test_neighbours_follow_the_order_of_any_ids(spark, tmp_path):
    ids = [i * i * 7 - 50 for i in range(300)]
    rows = spark.createDataFrame([(i, i + 1) for i in ids] + [(ids[5], -1), (ids[6], None), (None, 0)], "k long, v long").repartition(5)
    want = [(i, i + 1, j + 1) for i, j in zip(ids, ids[1:])] + [(ids[4], ids[4] + 1, -1), (ids[5], -1, ids[6] + 1), (ids[5], ids[5] + 1, None), (ids[5], -1, None), (ids[6], None, ids[7] + 1)]
    assert sorted(map(tuple, joins.following(rows, "k", "v").collect()), key=repr) == sorted(want, key=repr)
    assert not joins.following(rows.limit(0), "k", "v").count()
    spark.createDataFrame([(2, "a b c"), (4, "a b"), (10, "b"), (11, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.jaccard for r in QUERIES["C03_similarity"](spark, str(tmp_path)).collect()}
    assert got == {2: 0.666667, 4: 0.5, 10: 0.0}


def test_day_bounds():
    assert readers.day_bounds("2024-01-02", "2024-01-03") == ("2024-01-02 00:00:00", "2024-01-03 23:59:59.999999")
    assert readers.day_bounds(None, "2024-01-03 10:00:00") == (None, "2024-01-03 10:00:00")


def test_flat_map_refuses_reserved_names(spark):
    df = spark.sql("SELECT 'a' AS asset_id, map('x', 1.0D) AS values")
    assert core.flatten_map(df, "values", ["x", "y"]).first().asDict() == {"asset_id": "a", "x": 1.0, "y": None}
    with pytest.raises(ValueError, match="asset_id"):
        core.flatten_map(df, "values", ["asset_id"])


def test_passthrough_keeps_order(spark):
    assert core.passthrough(spark.sql("SELECT 1 AS b, 2 AS a"), ["a", "c", "b"]) == ["a", "b"]


def test_holding_days_and_labels(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 4), "Negative"), (date(2024, 1, 1), date(2024, 1, 1), None)], "a date, b date, l string")
    assert [tuple(x) for x in df.select(core.holding_days(F.col("a"), F.col("b")), core.signed_label(F.col("l"), F.lit(0.5))).collect()] == [(3.0, -0.5), (None, 0.0)]


def test_limit_violations(spark):
    df = spark.createDataFrame([(1, "s", 0.5, 1.0), (1, "s", 0.5, 1.0), (2, None, 0.1, 1.0), (2, "u", -0.1, 1.0)], "ts int, sector string, weight double, beta double")
    got = {r.ts: r.violated for r in portfolio.violations(df, ["ts"], portfolio.Limits()).collect()}
    assert got == {1: ["max_position_weight", "max_gross_exposure", "max_net_exposure", "max_beta_exposure", "max_sector_weight"], 2: []}


def test_entry_budget_leaves_room_for_the_exit():
    lim = portfolio.Limits()
    assert portfolio.entry_budget(lim)["max_daily_turnover"] * 2.25 == pytest.approx(lim.max_daily_turnover)
    assert portfolio.entry_budget(lim, round_trip=False)["max_participation_rate"] == lim.max_participation_rate


def test_annualized(spark):
    df = spark.createDataFrame([(0.1, 52), (-1.0, 3), (0.0, 0)], "r double, n int")
    assert [round(x[0], 9) for x in df.select(portfolio.annualized(F.col("r"), F.col("n"), 52.0)).collect()] == [0.1, -1.0, 0.0]


def test_outcome_rows_keep_whole_decisions_only(spark):
    d = date(2024, 1, 1)
    df = spark.createDataFrame([(1, d, d), (1, d, d), (2, d, d), (2, None, None), (3, d, date(2025, 1, 1))], "ts int, label_start date, label_end date")
    assert [r.ts for r in quality.outcome_rows(df, "ts", "2024-01-01", "2024-12-31").collect()] == [1, 1]


def test_forbidden_keys(spark):
    df = spark.createDataFrame([(1, '{"holdout": 1}'), (2, '{"a": {"holdout": 1}}'), (3, None), (4, "no json")], "id int, j string")
    assert [r.id for r in quality.forbidden_keys(df, "j", ["holdout"]).collect()] == [1]


def test_fit_and_frozen(spark):
    df = spark.createDataFrame([(i, float(i), 7.0, 2.0 * i if i < 8 else None) for i in range(10)], "decision int, a double, b double, y double")
    got = {r.feature: r for r in models.fit(df, ["a", "b"]).collect()}
    assert got["a"].n == 8 and got["a"].weight == pytest.approx(1.0) and (got["b"].scale, got["b"].weight) == (1.0, 0.0)
    snaps = spark.createDataFrame([(3, "a", 1.0, 2.0, 0.5), (9, "a", 9.0, 9.0, 9.0)], "decision int, feature string, mean double, scale double, weight double")
    assert {r.decision: r.score for r in models.frozen(df, snaps, 7, ["a"], ["decision"]).collect()} == {8: 1.75, 9: 2.0}


def test_families_split_by_prefix():
    f = models.families(["return_1d", "text_count", "llm_event_share"])
    assert (f["traditional"], f["text"], f["llm"], f["combined"], f["traditional_llm"]) == (["return_1d"], ["text_count"], ["llm_event_share"], ["return_1d", "text_count"], ["return_1d", "llm_event_share"])
    assert len(f["all"]) == 3


def test_batched_inference(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id int, s string")
    rows = inference.predict_batches(df, "s", lambda: lambda s: s.map(lambda x: len(x) if x else 0), "n", "long").collect()
    assert {r.id: r.n for r in rows} == {1: 2, 2: 0}
    with pytest.raises(Exception, match="answer every row"):
        inference.predict_batches(df.coalesce(1), "s", lambda: lambda s: s[:0], "n", "long").collect()


def test_bundle_notices_a_changed_table(spark, tmp_path):
    at = f"{tmp_path}/b"
    m = stores.write_bundle({"x": spark.range(3).toDF("a"), "y": spark.range(2).toDF("b")}, at)
    assert {(r.name, r.rows) for r in m.collect()} == {("x", 3), ("y", 2)} and set(stores.load_bundle(spark, at)) == {"x", "y"}
    spark.range(1, 4).toDF("a").write.mode("overwrite").parquet(f"{at}/x")
    with pytest.raises(ValueError, match="changed table: x"):
        stores.load_bundle(spark, at)


def test_content_addressed(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None)], "k int, t string")
    assert [(r.first, r.copies, r.length) for r in stores.content_addressed(df, "t", "k").collect()] == [(1, 2, 1)]


def test_synthetic_paths_are_reproducible_and_consistent(spark):
    a = synthetic.price_paths(spark, 3, 20, 1)
    assert sorted(a.collect()) == sorted(synthetic.price_paths(spark, 3, 20, 1).repartition(3).collect())
    assert a.where("high < greatest(open, close) OR low > least(open, close)").count() == 0
    assert a.where("session = 0").selectExpr("round(max(abs(open - 100)), 6)").first()[0] == 0


def test_recent_candidates(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(5)], "b int, at int, k int")
    assert sorted(r.k for r in text.recent_candidates(df, "b", "at", "k", 2).collect()) == [3, 4]
