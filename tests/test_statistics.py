import collections
import hashlib
import math
import random
from datetime import date, datetime

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.costs import CostModel
from tidemark.operators import paper, portfolio, statistics
from tidemark.sources import readers
from tidemark.streaming import windows


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", i, float(i % 5)) for i in range(20)] + [("c", i, 2.0) for i in range(6)] + [("one", 0, 1.5)], "g string, o int, value double")
    got = {r.g: r for r in statistics.block_bootstrap(df, ["g"], "o", 3, 200, 7).collect()}
    assert got["a"].low <= got["a"]["mean"] <= got["a"].high and got["a"].n == 20
    assert (got["c"].low, got["c"].high, got["one"].low, got["one"].high) == (2.0, 2.0, 1.5, 1.5)
    assert got["c"].p_value == 1 / 201
    again = {r.g: r for r in statistics.block_bootstrap(df.repartition(3), ["g"], "o", 3, 200, 7).collect()}
    assert again == got


def test_shuffle_permutes_within_its_group(spark):
    df = spark.createDataFrame([(g, i, float(10 * g + i)) for g in range(3) for i in range(8)], "g int, o int, v double")
    got = {(r.g, r.o): r.v for r in statistics.seeded_shuffle(df, ["g"], "o", "v", 1).collect()}
    assert got == {(r.g, r.o): r.v for r in statistics.seeded_shuffle(df.repartition(4), ["g"], "o", "v", 1).collect()}
    for g in range(3):
        assert sorted(got[g, o] for o in range(8)) == [10.0 * g + i for i in range(8)]
    assert got != {(g, o): 10.0 * g + o for g in range(3) for o in range(8)}


def test_replay_against_a_plain_one(spark):
    lim, costs, rng = portfolio.Limits(), CostModel(), np.random.default_rng(5)
    rows = [(f, date(2024, 1, d), f"A{a}", float(rng.integers(-2, 3)), float(rng.integers(1, 9) * 1e6), float(rng.normal(0, 0.05))) for f in ("x", "y") for d in range(1, 9) for a in range(6)]
    df = spark.createDataFrame(rows, "family string, ts date, asset_id string, score double, dollar_volume double, forward_return double")
    got = {(r.family, r.ts): r for r in statistics.replay(df, 3, lim, costs, 1e6).collect()}
    for f in ("x", "y"):
        now = 1e6
        for d in range(1, 9):
            own = sorted((r for r in rows if r[0] == f and r[1].day == d and r[3]), key=lambda r: (-abs(r[3]), r[2]))[:3]
            if not own:
                assert (f, date(2024, 1, d)) not in got
                continue
            w = [np.sign(r[3]) * min(lim.max_position_weight, lim.max_gross_exposure / len(own), lim.max_participation_rate * r[4] / now) for r in own]
            net = sum(x * r[5] for x, r in zip(w, own)) - sum(map(abs, w)) * 2 * (costs.commission_bps + costs.half_spread_bps + costs.slippage_bps) / 1e4
            now *= max(0.0, 1 + net)
            assert abs(got[f, date(2024, 1, d)].equity - now) < 1e-3 and got[f, date(2024, 1, d)].trades == len(own)


def test_typed_readers(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"asset_id": "A", "period_end": "2024-03-31", "available_at": "2024-05-01T00:00:00Z", "values": {"eps": "1.5"}}\n')
    f = readers.fundamentals(spark, str(tmp_path / "f.jsonl")).first()
    assert f.period_end == date(2024, 3, 31) and f["values"] == {"eps": "1.5"} and f.filing_id is None
    (tmp_path / "e.csv").write_text("asset_id,event_ts,available_at,status\nA,2024-05-01T20:00:00Z,2024-04-01T00:00:00Z,confirmed\n")
    assert readers.earnings(spark, str(tmp_path / "e.csv")).first().status == "confirmed"
    (tmp_path / "a.csv").write_text("asset_id,event_ts,available_at,action_type,value\nA,2024-05-01T20:00:00Z,2024-04-01T00:00:00Z,dividend,0.5\n")
    assert readers.actions(spark, str(tmp_path / "a.csv")).first().value == 0.5
    (tmp_path / "t.csv").write_text('item_id,title,entities,retention_permitted\n1,Hello,"[{""asset_id"": ""A"", ""relevance"": 0.5}]",no\n')
    x = readers.text_items(spark, str(tmp_path / "t.csv")).first()
    assert x.entities[0].asset_id == "A" and x.entities[0].relevance == 0.5 and x.retention_permitted is False
    (tmp_path / "b.csv").write_text("asset_id,ts,open,close,volume,session_date\nA,2024-05-01T20:00:00Z,1.5,2.5,10,2024-05-01\n")
    b = readers.bars(spark, str(tmp_path / "b.csv")).first()
    assert (b.open, b.volume, b.session_date, b.vwap) == (1.5, 10, date(2024, 5, 1), None)


def test_stream_sessions_and_novelty(spark, tmp_path):
    rows = [("a", datetime(2026, 1, 1, 10), "k"), ("a", datetime(2026, 1, 1, 12), "k"), ("a", datetime(2026, 1, 3, 10), "m")]
    spark.createDataFrame(rows, "asset_id string, available_at timestamp, key string").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("asset_id string, available_at timestamp, key string").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(60)
        return spark.table(name).collect()

    assert sorted(r.n for r in run(windows.sessions(read()), "bursts", "complete")) == [1, 2]
    assert sorted(r.key for r in run(windows.novel(read(), ["asset_id", "key"]), "firsts", "append")) == ["k", "m"]


def test_shuffle_is_seeded_by_the_key(spark):
    rows = [("d1", i, float(i)) for i in range(9)] + [("d2", i, float(i)) for i in range(5)]
    got = statistics.seeded_shuffle(spark.createDataFrame(rows, "ts string, asset_id long, score double"), ["ts"], "asset_id", "score", 23).orderBy("ts", "asset_id").collect()
    for d, n in (("d1", 9), ("d2", 5)):
        want = [float(i) for i in range(n)]
        random.Random(int.from_bytes(hashlib.sha256(f"23|{d}".encode()).digest()[:8], "big")).shuffle(want)
        assert [r.score for r in got if r.ts == d] == want


def test_scenarios(spark):
    rows = [(t, a, float(10 * t + i), 1.0) for t in range(6) for i, a in enumerate("xy")]
    s = paper.scenarios(spark.createDataFrame(rows, "ts int, asset_id string, score double, beta double"), "ts", ["asset_id"], 2, 1, {"news": F.col("score") * 0}, 7)
    got = {(r.scenario, r.ts, r.asset_id): r.score for r in s.collect()}
    per = collections.Counter(k[0] for k in got)
    assert per == {"baseline": 12, "endpoint_shift_early": 8, "endpoint_shift_late": 8, "causal_delay": 10, "source_ablation:news": 12, "shuffled_text": 12}
    assert got["causal_delay", 3, "y"] == 21.0 and got["source_ablation:news", 3, "y"] == 0.0 and {got["shuffled_text", 3, a] for a in "xy"} == {30.0, 31.0}


def test_compare_adjusts_over_groups(spark):
    rng = random.Random(3)
    rows = [(g, t, shift + rng.gauss(0, 1), 0.0) for g, shift in (("a", 3.0), ("b", 0.0), ("c", -3.0)) for t in range(40)] + [("d", 0, 1.0, 1.0)]
    got = {r.g: r for r in statistics.compare(spark.createDataFrame(rows, "g string, t int, candidate double, control double"), ["g"], "t", 4, 200, 5).collect()}
    ordered, worst = sorted(got.values(), key=lambda r: (r.p_value, r.g)), 0.0
    for i, r in enumerate(ordered):
        worst = max(worst, min(1.0, (len(ordered) - i) * r.p_value))
        assert math.isclose(r.holm_p_value, worst)
    assert got["a"].low > 2 and not got["a"].negative and got["c"].negative and got["b"].p_value > got["a"].p_value and got["d"].low == got["d"].high == 0.0 and got["d"].negative
