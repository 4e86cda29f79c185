"""Paper accounts: batch and stream against a plain loop over dictionaries."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.costs import CostModel
from tidemark.operators.accounts import EVENT, Rules, replay
from tidemark.operators.portfolio import Limits
from tidemark.streaming.accounts import paper_accounts

RULES = Rules(Limits(max_position_weight=0.3, max_sector_weight=0.4, max_gross_exposure=0.9, max_net_exposure=0.3, max_beta_exposure=0.25, max_daily_turnover=0.7, max_participation_rate=0.05, min_price=5.0, min_dollar_volume=1e5), CostModel(), 1e6)


def events(rng, account, n, kinds):
    out, at = [], dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for i in range(n):
        at += dt.timedelta(days=rng.choice([0, 1, 1, 2]))
        kind = rng.choice(kinds)
        legs = []
        for a in rng.sample("ABCDEFGH", rng.randrange(1, 8)):
            market = kind == "mark" or rng.random() < 0.9
            legs.append((a, rng.choice([None, 0.0, 0.1, 0.35, -0.2, 0.5]) if kind != "mark" else None, rng.choice([3.0, 20.0, 50.0]) if market else None, rng.choice([0.0, 9e5, 8e6, 5e7]) if market else None, rng.choice(["x", "y", None, ""]),
                         rng.choice([None, 0.5, 1.2, float("nan")]), rng.choice([None, 0.01, 0.04]), rng.choice([True, True, False]), rng.choice([None, True, False]), rng.choice([None, -0.1, 0.02, 0.3, -1.5])))
        when = at - dt.timedelta(days=30) if rng.random() < 0.03 else at
        out.append((account, when, i, kind, 3.0, legs))
    return out


def cap(total, limit):
    return limit / total if total > limit else 1.0


def plain(all_events, rules):
    """One account's outcomes, by an ordinary loop."""
    lim, c = rules.limits, rules.costs
    equity, last, held, known, out = rules.capital, None, {}, {}, []
    num = lambda x: 0.0 if x is None or x != x else x

    def cost(traded, vol, part):
        return abs(traded) * ((c.commission_bps + c.half_spread_bps + c.slippage_bps) / 1e4 + vol * c.volatility_slippage_multiplier + part * c.participation_slippage_bps / 1e4 + vol * part**0.5 * c.market_impact_multiplier)

    def choose(desired, have, market, turnover, participation, equity):
        rejected, t = {}, {}
        for a, w in desired.items():
            w = max(-lim.max_position_weight, min(lim.max_position_weight, w))
            m = market.get(a)
            if abs(w) <= 1e-12:
                continue
            why = ["missing_market_data"] if m is None else [n for n, bad in (("min_price", m["price"] < lim.min_price), ("min_dollar_volume", m["volume"] < lim.min_dollar_volume), ("short_unavailable", w < 0 and not m["short"]), ("hard_to_borrow", w < 0 and m["hard"])) if bad]
            if why:
                rejected[a] = why
            else:
                t[a] = w
        sector, beta = lambda a: market.get(a, {}).get("sector", "UNKNOWN"), lambda a: market.get(a, {}).get("beta", 1.0)
        for s in {sector(a) for a in t}:
            k = cap(sum(abs(w) for a, w in t.items() if sector(a) == s), lim.max_sector_weight)
            t = {a: w * k if sector(a) == s else w for a, w in t.items()}
        k = cap(sum(map(abs, t.values())), lim.max_gross_exposure)
        t = {a: w * k for a, w in t.items()}
        lo, sh = sum(w for w in t.values() if w > 0), -sum(w for w in t.values() if w < 0)
        if lo - sh > lim.max_net_exposure:
            t = {a: w * (sh + lim.max_net_exposure) / lo if w > 0 else w for a, w in t.items()}
        elif sh - lo > lim.max_net_exposure:
            t = {a: w * (lo + lim.max_net_exposure) / sh if w < 0 else w for a, w in t.items()}
        k = cap(abs(sum(w * beta(a) for a, w in t.items())), lim.max_beta_exposure)
        t = {a: w * k for a, w in t.items()}
        names = sorted({*t, *have})
        d = {a: t.get(a, 0.0) - have.get(a, 0.0) for a in names}
        k = cap(sum(map(abs, d.values())), turnover)
        new = {}
        for a in names:
            move, v = d[a] * k, market.get(a, {}).get("volume", 0.0)
            if abs(move) > 1e-12 and v <= 0:
                rejected[a] = sorted({*rejected.get(a, []), "missing_dollar_volume"})
                move = 0.0
            elif abs(move) * equity > participation * v:
                move = (1 if move > 0 else -1) * participation * v / equity
            new[a] = have.get(a, 0.0) + move
        new = {a: w for a, w in new.items() if abs(w) > 1e-12}
        sectors = [sum(abs(w) for a, w in new.items() if sector(a) == s) for s in {sector(a) for a in new}]
        k = min([1.0, *(cap(abs(w), lim.max_position_weight) for w in new.values()), cap(sum(map(abs, new.values())), lim.max_gross_exposure), cap(abs(sum(new.values())), lim.max_net_exposure),
                 cap(abs(sum(w * beta(a) for a, w in new.items())), lim.max_beta_exposure), *(cap(s, lim.max_sector_weight) for s in sectors)])
        new = {a: w * k for a, w in new.items() if abs(w * k) > 1e-12}
        d = {a: new.get(a, 0.0) - have.get(a, 0.0) for a in names}
        if sum(map(abs, d.values())) > turnover + 1e-10:
            return "max_daily_turnover"
        part = {}
        for a in names:
            if abs(d[a]) > 1e-12:
                if market.get(a, {}).get("volume", 0.0) <= 0:
                    return "missing_dollar_volume"
                part[a] = abs(d[a]) * equity / market[a]["volume"]
        return "max_participation_rate" if any(p > participation + 1e-10 for p in part.values()) else (new, d, part, rejected)

    for _, at, seq, kind, days, legs in sorted(all_events, key=lambda e: (e[1], e[2])):
        status, gross, paid, turnover, rejected = "ok", 0.0, 0.0, 0.0, {}
        rows = {x[0]: {"price": num(x[2]), "volume": num(x[3]), "sector": x[4] or "UNKNOWN", "beta": rules.missing_beta if x[5] is None or x[5] != x[5] else x[5], "vol": rules.missing_volatility if x[6] is None else x[6], "short": bool(x[7]), "hard": bool(x[8])} for x in legs}
        wanted = {x[0]: x[1] for x in legs if x[1] is not None}
        if last is not None and at < last:
            status = "refused: time_order"
        elif kind == "mark":
            r = {x[0]: num(x[9]) for x in legs}
            gross = sum(w * r.get(a, 0.0) for a, w in held.items())
            equity *= max(0.0, 1 + gross)
            held = {a: w * (1 + r.get(a, 0.0)) / (1 + gross) for a, w in held.items() if abs(w) > 1e-12} if gross > -1 else {}
            last = at
        elif not wanted and kind == "rebalance":
            status = "refused: no_intent"
        elif kind == "rebalance":
            seen = {x[0]: rows[x[0]] for x in legs if x[2] is not None or x[3] is not None}
            market = {a: known[a] for a in held if a in known} | seen
            got = choose(wanted, held, market, lim.max_daily_turnover, lim.max_participation_rate, equity)
            if isinstance(got, str):
                status = f"refused: {got}"
            else:
                known = known | seen
                held, d, part, rejected = got
                turnover = sum(map(abs, d.values()))
                paid = sum(cost(d[a], known.get(a, {}).get("vol", 0.0), p) for a, p in part.items())
                equity *= max(0.0, 1 - paid)
                last = at
        elif kind == "round_trip":
            got = choose(wanted, {}, rows, lim.max_daily_turnover / 2.1, lim.max_participation_rate / 1.1, equity)
            if held:
                status = "refused: not_flat"
            elif isinstance(got, str):
                status = f"refused: {got}"
            else:
                new, d, part, rejected = got
                r = {x[0]: num(x[9]) for x in legs}
                gross = sum(w * r[a] for a, w in new.items())
                growth = max(0.0, 1 + gross)
                paid = sum(cost(w, rows[a]["vol"], part[a]) for a, w in new.items())
                after = {a: w * (1 + r[a]) / (1 + gross) for a, w in new.items()} if gross > -1 else {}
                parts = {a: abs(w) * equity * growth / rows[a]["volume"] for a, w in after.items()}
                paid += sum(growth * cost(w, rows[a]["vol"], parts[a]) for a, w in after.items()) - sum(min(0.0, w) for w in new.values()) * c.borrow_bps_per_year / 1e4 * days / 365
                turnover = sum(map(abs, new.values())) + growth * sum(map(abs, after.values()))
                if any(p > lim.max_participation_rate + 1e-12 for p in parts.values()):
                    status = "refused: exit_participation"
                elif turnover > lim.max_daily_turnover + 1e-12:
                    status = "refused: exit_turnover"
                if status != "ok":
                    gross, paid, turnover, rejected = 0.0, 0.0, 0.0, {}
                else:
                    equity *= max(0.0, 1 + gross - paid)
                    known, last = known | rows, at
        out.append((seq, status, equity, gross, paid, turnover, rejected, dict(held)))
    return out


def close(got, want):
    assert [(r.seq, r.status) for r in got] == [w[:2] for w in want]
    for r, w in zip(got, want, strict=True):
        assert [r.equity, r.gross_return, r.cost_return, r.turnover] == pytest.approx(list(w[2:6]), rel=1e-9, abs=1e-12), w
        assert {a: sorted(x) for a, x in r.rejected.items()} == {a: sorted(x) for a, x in w[6].items()}
        assert dict(r.positions) == pytest.approx(w[7], rel=1e-9, abs=1e-12)


@pytest.fixture(scope="module")
def log():
    rng = random.Random(6)
    return {"one": events(rng, "one", 400, ["rebalance", "mark"]), "two": events(rng, "two", 300, ["round_trip"]), "three": events(rng, "three", 200, ["rebalance", "mark", "snapshot", "round_trip"])}


def test_replay(spark, log):
    df = spark.createDataFrame([e for x in log.values() for e in x], EVENT)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = replay(df.repartition(5), RULES).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, own in log.items():
        want = plain(own, RULES)
        close([r for r in got if r.account == name], want)
        assert len({w[1] for w in want}) > 2  # some events are refused
    assert any(w[6] for w in plain(log["one"], RULES)) and replay(df.limit(0), RULES).count() == 0
    assert all(set(r.flags) <= {"missing_beta_conservative_fallback", "missing_volatility_conservative_fallback"} for r in got) and any(r.flags for r in got)


def test_stream_in_micro_batches_equals_the_loop(spark, log, tmp_path):
    """Stopped half-way and resumed from its checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ordered = {k: sorted(x, key=lambda e: (e[1], e[2])) for k, x in log.items()}
    seen = []

    def run():
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = paper_accounts(stream, RULES).writeStream.foreachBatch(lambda df, n: seen.append((n, df.collect()))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    try:
        for part in range(4):
            rows = [e for x in ordered.values() for e in x[part * 30 : (part + 1) * 30]]
            spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if part in (1, 3):
                run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len(seen) == 4
    got = [r for _, rows in sorted(seen) for r in rows]
    for name, own in ordered.items():
        close([r for r in got if r.account == name], plain(own[:120], RULES))


def test_capital_and_odd_events(spark):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    leg = ("A", 0.2, 10.0, 1e9, None, 1.0, 0.0, True, False, 0.5)
    rows = [("a", at, 0, "bogus", None, None), ("a", None, 1, "mark", None, []), ("a", at, 2, "round_trip", None, [leg, None, (None, *leg[1:])]), (None, at, 0, "snapshot", None, None)]
    df = spark.createDataFrame(rows, EVENT)
    got = {(r.account, r.seq): r for r in replay(df.withColumn("capital", F.lit(100.0)), Rules()).collect()}
    assert [got["a", i].status for i in range(3)] == ["refused: unknown_kind", "refused: time_order", "ok"]
    assert got["a", 2].gross_return == pytest.approx(0.1) and 109.0 < got["a", 2].equity < 110.0 and got[None, 0].equity == 100.0
