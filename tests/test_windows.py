"""Text windows by panes against pairs of decisions and signals."""

import datetime as dt
import math
import random

import pytest

from tidemark.operators import textwindow

SCHEMA = "asset_id string, avail {kind}, item_id long, novelty double, sentiment double, relevance double, confidence double, credibility double, spam double, source_type string, author string, event_type string"


def made(rng, n, times):
    pick = rng.choice
    return [(pick("AB"), pick(times), rng.randrange(n // 2), pick([0.0, 1.0, 1.0]), pick([None, -1.0, -0.5, 0.0, 0.5, 1.0]), pick([0.2, 0.9]), pick([0.5, 1.0]), pick([0.3, 0.8]), pick([0.0, 0.4]), pick(["x", "y", None]), pick(["p", "q", "r", None]), pick(["F", "O", None])) for _ in range(n)]


def plain(asset, at, signals, days, age_of, half_life=3.0):
    """The features of one decision from its own pairs."""
    own = [(age_of(at, r[1]), r) for r in signals if r[0] == asset and r[1] is not None]
    raw = [(a, r) for a, r in own if 0 <= a < days]
    ev = [(a, r) for a, r in raw if r[3] > 0.5]
    mean = lambda v: sum(v) / len(v) if v else 0.0
    s = [r[4] for _, r in ev if r[4] is not None]

    def weighted(w):
        total = sum(w(a, r) for a, r in ev)
        return sum(w(a, r) * (r[4] or 0.0) for a, r in ev) / total if total > 0 else 0.0

    new, old = [r[4] for a, r in ev if a < days / 2 and r[4] is not None], [r[4] for a, r in ev if a >= days / 2 and r[4] is not None]
    some = any(a < days / 2 for a, _ in ev) and any(a >= days / 2 for a, _ in ev)
    decay = lambda a: 2.0 ** (-a / half_life)
    different = lambda i: len({r[i] for _, r in ev if r[i] is not None})
    before = sum(1 for a, r in own if days <= a < 2 * days and r[3] > 0.5)
    return {"raw_text_count": len(raw), "text_count": len(ev), "duplicate_item_count": len(raw) - len(ev), "latest_text_age_days": min((a for a, _ in ev), default=None), "time_since_first_seen_days": max((a for a, _ in ev), default=None),
            "attention_unique_item_count": different(2), "source_diversity_count": different(9), "unique_author_count": different(10), "event_type_diversity": different(11), "event_f_count": sum(r[11] == "F" for _, r in ev),
            "sentiment_mean": mean(s), "sentiment_dispersion": math.sqrt(mean([(x - mean(s)) ** 2 for x in s])), "sentiment_max_positive": max([0.0, *s]), "sentiment_max_negative": min([0.0, *s]), "sentiment_acceleration": mean(new) - mean(old) if some else 0.0,
            "sentiment_positive_negative_ratio": (sum(x > 0.05 for x in s) + 1) / (sum(x < -0.05 for x in s) + 1) if ev else 0.0, "sentiment_conf_weighted_total": None, "text_decay_weight_sum": sum(decay(a) for a, _ in ev),
            "attention_abnormal": len(ev) / before if before else len(ev), "novelty_share": mean([r[3] for _, r in raw]), "source_credibility_mean": mean([r[7] for _, r in ev]), "text_missing": not ev,
            **({"sentiment_relevance_weighted": weighted(lambda a, r: r[5]), "sentiment_decay_weighted": weighted(lambda a, r: decay(a) * r[6] * r[5] * r[7] * (1 - r[8]))} if all(r[4] is not None for _, r in ev) else {})}


@pytest.mark.parametrize("kind", ["bigint", "timestamp"])
@pytest.mark.parametrize("days", [7, 3])
def test_panes_equal_pairs(spark, kind, days):
    rng = random.Random(days)
    if kind == "bigint":
        times, asked = [*range(9000, 9060), None], [*range(8995, 9075)]
        age = lambda at, t: at - t
    else:
        start = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
        times = [start + dt.timedelta(minutes=rng.randrange(40 * 24 * 60)) for _ in range(200)] + [start, start + dt.timedelta(days=days)]
        asked = [start + dt.timedelta(hours=11 * i) for i in range(90)] + [start + dt.timedelta(days=days), start + dt.timedelta(days=2 * days)]
        age = lambda at, t: (at - t).total_seconds() / 86400
    signals = made(rng, 260, times)
    df = spark.createDataFrame(signals, SCHEMA.format(kind=kind))
    decisions = spark.createDataFrame([(a, t, "kept") for a in "ABC" for t in asked], f"asset_id string, asof_day {kind}, note string")
    out = textwindow.features(decisions, df, days, ["F", "O"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    got = out.collect()
    assert len(got) == 3 * len(asked) and all(r.note == "kept" for r in got)
    for r in got:
        at = r.asof_day if kind == "bigint" else r.asof_day.replace(tzinfo=dt.timezone.utc)
        for name, want in plain(r.asset_id, at, signals, days, age).items():
            if name in r:
                assert (r[name] is None) == (want is None) and (want is None or r[name] == pytest.approx(want, abs=1e-8)), (name, r.asset_id, at)


def test_no_signals_no_decisions(spark):
    df = spark.createDataFrame([], SCHEMA.format(kind="bigint"))
    one = spark.createDataFrame([("A", 5)], "asset_id string, asof_day bigint")
    got = textwindow.features(one, df, 7, ["F"]).first()
    assert got.text_missing and got.text_count == 0.0 and got.latest_text_age_days is None
    assert textwindow.features(one.limit(0), df, 7, ["F"]).count() == 0
