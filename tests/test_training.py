"""The walk-forward protocol against a plain loop over decisions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import training

FAMILIES = {"one": ["a"], "both": ["a", "b"]}
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def made(decisions=30, assets=4, delay=2, tail=2):
    rng = random.Random(9)
    out = []
    for d in range(decisions):
        for a in range(assets):
            seen = d < decisions - tail
            out.append((f"A{a}", START + dt.timedelta(hours=7 * d), START + dt.timedelta(hours=7 * (d + rng.choice([1, delay]))) if seen else None, rng.gauss(0, 1) if seen else None, rng.gauss(0, 1) if rng.random() < 0.9 else None, float(d % 3), rng.gauss(0, 1)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "asset_id string, decision timestamp, avail timestamp, y double, a double, b double, return_5d double")


def plain(rows, embargo, holdout, least):
    """{(decision, family): (cutoff, frozen, n, residual, {feature: (mean, scale, weight)})}"""
    times = sorted({r[1] for r in rows})
    seen = [t for t in times if all(r[3] is not None for r in rows if r[1] == t)]
    start = seen[-holdout] if holdout else None
    out = {}
    for i, t in enumerate(times):
        frozen = start is not None and t >= start
        cut = times[max(0, (times.index(start) if frozen else i) - embargo)]
        own = [r for r in rows if r[1] in seen and r[2] is not None and r[2] < cut and (start is None or r[1] < start)]
        own = own if len(own) >= least else []
        y = [r[3] for r in own]
        mean = lambda v: sum(v) / len(v) if v else 0.0
        var = lambda v: mean([(x - mean(v)) ** 2 for x in v])
        for family, features in FAMILIES.items():
            fit = {}
            for f in features:
                x = [r[4 + "ab".index(f)] or 0.0 for r in own]
                fit[f] = (mean(x), var(x) ** 0.5 or 1.0, mean([(p - mean(x)) * (q - mean(y)) for p, q in zip(x, y)]) / (var(x) * var(y)) ** 0.5 if var(x) > 1e-12 and var(y) > 1e-12 else 0.0)
            total = sum(abs(w) for *_, w in fit.values()) or 1.0
            out[t, family] = (cut, frozen, len(own), var(y) ** 0.5, {f: (m, s, w / total) for f, (m, s, w) in fit.items()})
    return out


@pytest.mark.parametrize("embargo,holdout,least", [(0, 0, 0), (2, 6, 10), (40, 3, 1)])
def test_snapshots(spark, embargo, holdout, least):
    rows = made()
    got = training.train(frame(spark, rows), FAMILIES, F.concat("asset_id", F.col("decision").cast("string")), least, embargo, holdout).collect()
    want = plain(rows, embargo, holdout, least)
    utc = lambda t: t.replace(tzinfo=dt.timezone.utc) if t.tzinfo is None else t
    assert len(got) == sum(len(v[4]) for v in want.values())
    for r in got:
        cut, frozen, n, residual, fit = want[utc(r.decision), r.family]
        assert (utc(r.cutoff), r.role == training.FROZEN, r.n) == (cut, frozen, n)
        assert (r.mean, r.scale, r.weight, r.residual_scale) == pytest.approx((*fit[r.feature], residual), abs=1e-9)
    if holdout:
        assert len({(r.cutoff, r.n, r.key_digest) for r in got if r.role == training.FROZEN}) == 1


def test_predictions_and_benchmarks(spark):
    rows = made(12, 3)
    df = frame(spark, rows)
    s = training.train(df, FAMILIES, F.col("asset_id"), 3, 1, 0)
    got = {(r.family, r.asset_id, r.decision.hour + 24 * r.decision.day): r for r in training.predict(df, s, FAMILIES, ["asset_id"]).collect()}
    assert len(got) == 5 * len(rows)
    want = plain(rows, 1, 0, 3)
    for asset, t, _, _, a, b, momentum in rows:
        at = t.hour + 24 * t.day
        _, _, n, residual, fit = want[t, "both"]
        assert got["both", asset, at].score == pytest.approx(sum(((x or 0.0) - fit[f][0]) / fit[f][1] * fit[f][2] for f, x in (("a", a), ("b", b))), abs=1e-9)
        assert got["both", asset, at].uncertainty == pytest.approx(residual) and got["both", asset, at].training_rows == n
        assert (got["momentum_only", asset, at].score, got["equal_weight", asset, at].score, got["no_trade", asset, at].score, got["no_trade", asset, at].uncertainty) == (momentum, 1.0, 0.0, None)
    p = training.predict(df, s, FAMILIES, ["asset_id"])
    assert training.uneven_families(p, ["asset_id", "decision"]).count() == 0
    less = p.where("NOT (family = 'one' AND asset_id = 'A1')").unionByName(p.where("family = 'both' AND asset_id = 'A0'"))
    assert {(r.family, r.asset_id, r.problem) for r in training.uneven_families(less, ["asset_id", "decision"]).collect()} == {("one", "A1", "missing"), ("both", "A0", "repeated")}


def test_windows_purge_a_suffix(spark):
    rows = [("A", START + dt.timedelta(days=i), START + dt.timedelta(days=i + (5 if i == 6 else 1)), 1.0, 1.0, 1.0, 0.0) for i in range(12)]
    got = [r.window for r in training.windows(frame(spark, rows), 3).orderBy("decision").collect()]
    assert got == ["development"] * 6 + ["purged"] * 3 + ["final_holdout"] * 3  # day 6 is known on day 11; 7 and 8 follow it
    assert {r.window for r in training.windows(frame(spark, rows), 0).collect()} == {"development"}


def test_incomplete_cross_sections(spark):
    rows = made(8, 2, tail=0)
    partial = [(*r[:3], None, *r[4:]) if i == 5 else r for i, r in enumerate(rows)]
    uncovered = [(*r[:3], None, *r[4:]) if r[1] == rows[4][1] else r for r in rows]
    for odd, status in ((partial, "partial"), (uncovered, "uncovered")):
        assert [r.status for r in training.cross_sections(frame(spark, odd)).collect()].count(status) == 1
        with pytest.raises(ValueError):
            training.train(frame(spark, odd), FAMILIES, F.col("asset_id"))
        assert training.train(frame(spark, odd), FAMILIES, F.col("asset_id"), strict=False).count() == 8 * 3
    assert training.train(frame(spark, []), FAMILIES, F.col("asset_id"), holdout=2).count() == 0


def test_protocol_violations(spark):
    df = frame(spark, made())
    s = training.train(df, FAMILIES, F.concat("asset_id", F.col("decision").cast("string")), 5, 2, 6)
    claim = training.protocol(df, s, 6)
    broken = lambda c, snaps=s: training.protocol_violations(c, df, snaps, 6).first().broken
    assert broken(claim) == []
    late = F.col("cutoff") + F.expr("INTERVAL 9 DAYS")
    assert broken(claim.withColumn("cutoff", late)) == ["cutoff_after_start", "updated_in_holdout"]
    assert broken(claim, training.train(df, FAMILIES, F.concat("asset_id", F.col("decision").cast("string")), 5, 2, 0)) == ["updated_in_holdout"]
    assert broken(training.protocol(df, s, 5)) == ["holdout_start", "holdout_periods"]
