"""Paper accounts with state: what an account holds decides what it may trade next.

An account is a key. Its events come in order of time: ``rebalance`` to given targets,
``mark`` to the returns since, ``round_trip`` (entry from cash, forced exit at the horizon)
and ``snapshot``. A batch is sorted by Spark and streamed through tasks, so no account is
collected; a stream keeps each account as typed keyed state (``tidemark.streaming.accounts``).
Both run the same step, which sees one event and what the account holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.costs import CostModel
from .portfolio import Limits, entry_budget

LEG = ("struct<asset_id: string, target: double, price: double, dollar_volume: double, sector: string, beta: double, volatility: double, "
       "short_available: boolean, hard_to_borrow: boolean, forward_return: double>")
EVENT = f"account string, at timestamp, seq bigint, kind string, holding_days double, legs array<{LEG}>"
TRADE = "struct<asset_id: string, phase: string, previous: double, target: double, participation: double, cost: double>"
OUTCOME = (f"account string, at timestamp, seq bigint, kind string, status string, equity double, gross_return double, cost_return double, turnover double, "
           f"gross double, net double, beta double, trades array<{TRADE}>, rejected map<string, array<string>>, flags array<string>, positions map<string, double>")
OUTCOME_COLUMNS = ["account", "at", "seq", "kind", "status", "equity", "gross_return", "cost_return", "turnover", "gross", "net", "beta", "trades", "rejected", "flags", "positions"]
#: Weights and moves up to here are none; limits may be passed by so much.
NONE, TOLERANCE = 1e-12, 1e-10
KINDS = ("rebalance", "mark", "round_trip", "snapshot")


@dataclass(frozen=True)
class Rules:
    """What holds for every account: limits, costs, starting capital, and stand-ins for unknown risk. A round trip within a session (``same_session``)
    keeps room for its exit, with a ``buffer``."""

    limits: Limits = field(default_factory=Limits)
    costs: CostModel = field(default_factory=CostModel)
    capital: float = 1e6
    missing_beta: float = 1.0
    missing_volatility: float = 0.03
    same_session: bool = True
    buffer: float = 0.1


@dataclass
class Account:
    """State of one account: equity, time of its last event, and by asset the weight held and what is known of it."""

    equity: float
    last: object = None
    held: dict[str, float] = field(default_factory=dict)
    known: dict[str, dict] = field(default_factory=dict)


class Refused(Exception):
    """The event can't be carried out safely; the account stays as it is."""


def _number(x: object) -> float:
    return float(x) if x is not None and np.isfinite(x) else 0.0


def _facts(leg: dict, rules: Rules) -> dict:
    """A market row, with cautious values for missing risk and the flags that say so."""
    beta, vol = leg.get("beta"), leg.get("volatility")
    no_beta, no_vol = beta is None or not np.isfinite(beta), vol is None or not np.isfinite(vol) or vol < 0
    flags = ["missing_beta_conservative_fallback"] * no_beta + ["missing_volatility_conservative_fallback"] * no_vol
    return {"price": _number(leg.get("price")), "dollar_volume": _number(leg.get("dollar_volume")), "sector": leg.get("sector") or "UNKNOWN", "beta": rules.missing_beta if no_beta else float(beta),
            "volatility": rules.missing_volatility if no_vol else float(vol), "short_available": bool(leg.get("short_available")), "hard_to_borrow": bool(leg.get("hard_to_borrow")), "flags": flags}


def _ineligible(weight: float, facts: dict | None, limits: Limits) -> list[str]:
    if facts is None:
        return ["missing_market_data"]
    short = weight < 0
    broken = {"min_price": facts["price"] < limits.min_price, "min_dollar_volume": facts["dollar_volume"] < limits.min_dollar_volume, "shorting_disabled": short and not limits.shorting_allowed,
              "short_unavailable": short and not facts["short_available"], "hard_to_borrow": short and facts["hard_to_borrow"] and not limits.hard_to_borrow_allowed}
    return [name for name, is_broken in broken.items() if is_broken]


def _within(total: float, limit: float) -> float:
    return limit / total if total > limit else 1.0


def constrained(desired: dict[str, float], held: dict[str, float], market: dict[str, dict], limits: Limits, equity: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, dict[str, list[str]]]:
    """(assets, weights held, weights wanted within all limits, participation, reasons of what was left out).

    Exposure limits bind the target, turnover and participation the way from what is held.
    Clipping can undo a hedge, so the result is scaled towards cash once more; where that
    needs more trading than is allowed, the event is refused.
    """
    names = sorted({*desired, *held})
    have = np.array([held.get(a, 0.0) for a in names])
    want = np.clip([desired.get(a, 0.0) for a in names], -limits.max_position_weight, limits.max_position_weight)
    left_out = {a: why for a, w in zip(names, want, strict=True) if abs(w) > NONE and (why := _ineligible(w, market.get(a), limits))}
    want = np.where([a in left_out for a in names], 0.0, want) * (np.abs(want) > NONE)
    facts = [market.get(a, {}) for a in names]
    beta = np.array([f.get("beta", 1.0) for f in facts])
    volume = np.array([f.get("dollar_volume", 0.0) for f in facts])
    sector = np.unique([f.get("sector", "UNKNOWN") for f in facts], return_inverse=True)[1] if names else np.zeros(0, int)

    def by_sector(w: np.ndarray) -> np.ndarray:
        return np.bincount(sector, np.abs(w)) if len(w) else np.zeros(0)

    if names:
        want = want * np.array([_within(g, limits.max_sector_weight) for g in by_sector(want)])[sector]
    want = want * _within(np.abs(want).sum(), limits.max_gross_exposure)
    long, short = want[want > 0].sum(), -want[want < 0].sum()
    want = want * np.where(want > 0, _within(long, short + limits.max_net_exposure), _within(short, long + limits.max_net_exposure))
    want = want * _within(abs(want @ beta), limits.max_beta_exposure)
    move = want - have
    move = move * _within(np.abs(move).sum(), limits.max_daily_turnover)
    room = limits.max_participation_rate * volume / max(equity, NONE)
    for a in (n for n, m, v in zip(names, move, volume, strict=True) if abs(m) > NONE and v <= 0):
        left_out[a] = sorted({*left_out.get(a, []), "missing_dollar_volume"})
    move = np.where((volume <= 0) | (np.abs(move) <= NONE), np.where(volume <= 0, 0.0, move), np.sign(move) * np.minimum(np.abs(move), room))
    want = have + move
    want = np.where(np.abs(want) > NONE, want, 0.0)
    scale = min([1.0, *(_within(x, limit) for x, limit in ((np.abs(want).max(initial=0), limits.max_position_weight), (np.abs(want).sum(), limits.max_gross_exposure), (abs(want.sum()), limits.max_net_exposure),
                                                          (abs(want @ beta), limits.max_beta_exposure), (by_sector(want).max(initial=0), limits.max_sector_weight)))])
    want = np.where(np.abs(want * scale) > NONE, want * scale, 0.0)
    move = want - have
    if np.abs(move).sum() > limits.max_daily_turnover + TOLERANCE:
        raise Refused("max_daily_turnover")
    moved = np.abs(move) > NONE
    if (moved & (volume <= 0)).any():
        raise Refused("missing_dollar_volume")
    part = np.where(moved, np.abs(move) * max(0.0, equity) / np.where(volume > 0, volume, 1.0), 0.0)
    if (part > limits.max_participation_rate + TOLERANCE).any():
        raise Refused("max_participation_rate")
    return names, have, want, part, left_out


def _exposure(account: Account) -> dict[str, float]:
    w = np.array(list(account.held.values()))
    beta = np.array([account.known.get(a, {}).get("beta", 1.0) for a in account.held])
    return {"gross": float(np.abs(w).sum()), "net": float(w.sum()), "beta": float(w @ beta) if len(w) else 0.0}


def _drifted(held: dict[str, float], returns: dict[str, float], gross: float) -> dict[str, float]:
    return {a: w * (1 + returns.get(a, 0.0)) / (1 + gross) for a, w in held.items() if abs(w) > NONE} if 1 + gross > 0 else {}


def _rebalance(account: Account, event: dict, rules: Rules) -> tuple[Account, dict]:
    legs = event["legs"]
    desired = {x["asset_id"]: _number(x["target"]) for x in legs if x["target"] is not None}
    if not desired:
        raise Refused("no_intent")
    seen = {x["asset_id"]: _facts(x, rules) for x in legs if x["price"] is not None or x["dollar_volume"] is not None}
    known = account.known | seen
    market = {a: known[a] for a in account.held if a in known} | seen
    names, have, want, part, left_out = constrained(desired, account.held, market, rules.limits, account.equity)
    trades, cost = [], 0.0
    for a, h, w, p in zip(names, have, want, part, strict=True):
        if abs(w - h) > NONE:
            one = rules.costs.amount(w - h, known.get(a, {}).get("volatility", 0.0), p)
            cost += one
            trades.append({"asset_id": a, "phase": "rebalance", "previous": float(h), "target": float(w), "participation": float(p), "cost": one})
    to = Account(account.equity * max(0.0, 1 - cost), event["at"], {a: float(w) for a, w in zip(names, want, strict=True) if w}, known)
    flags = sorted({f for a in to.held for f in known.get(a, {}).get("flags", [])})
    return to, {"cost_return": cost, "turnover": float(np.abs(want - have).sum()), "trades": trades, "rejected": left_out, "flags": flags}


def _mark(account: Account, event: dict, rules: Rules) -> tuple[Account, dict]:
    returns = {x["asset_id"]: _number(x["forward_return"]) for x in event["legs"]}
    gross = sum(w * returns.get(a, 0.0) for a, w in account.held.items())
    return Account(account.equity * max(0.0, 1 + gross), event["at"], _drifted(account.held, returns, gross), account.known), {"gross_return": gross}


def _round_trip(account: Account, event: dict, rules: Rules) -> tuple[Account, dict]:
    if account.held:
        raise Refused("not_flat")
    legs = {x["asset_id"]: x for x in event["legs"]}
    facts = {a: _facts(x, rules) for a, x in legs.items()}
    entry = replace(rules.limits, **entry_budget(rules.limits, rules.same_session, rules.buffer))
    desired = {a: _number(x["target"]) for a, x in legs.items() if x["target"] is not None}
    names, _, want, part, left_out = constrained(desired, {}, facts, entry, account.equity)
    returns = {a: _number(x["forward_return"]) for a, x in legs.items()}
    book = {a: (float(w), float(p)) for a, w, p in zip(names, want, part, strict=True) if w}
    gross = sum(w * returns[a] for a, (w, _) in book.items())
    growth = max(0.0, 1 + gross)
    trades, cost, out_turnover = [], 0.0, 0.0
    for a, (w, p) in book.items():
        one = rules.costs.amount(w, facts[a]["volatility"], p)
        trades.append({"asset_id": a, "phase": "entry", "previous": 0.0, "target": w, "participation": p, "cost": one})
        cost += one
    for a, w in _drifted({a: w for a, (w, _) in book.items()}, returns, gross).items():
        p = abs(w) * account.equity * growth / facts[a]["dollar_volume"]
        if p > rules.limits.max_participation_rate + NONE:
            raise Refused("exit_participation")
        one = growth * rules.costs.amount(w, facts[a]["volatility"], p)
        trades.append({"asset_id": a, "phase": "exit", "previous": w, "target": 0.0, "participation": p, "cost": one})
        cost, out_turnover = cost + one, out_turnover + abs(w)
    cost += rules.costs.amount(0.0, 0.0, 0.0, sum(min(0.0, w) for w, _ in book.values()), _number(event["holding_days"]))
    turnover = sum(abs(w) for w, _ in book.values()) + out_turnover * growth
    if (turnover if rules.same_session else out_turnover) > rules.limits.max_daily_turnover + NONE:
        raise Refused("exit_turnover")
    to = Account(account.equity * max(0.0, 1 + gross - cost), event["at"], {}, account.known | facts)
    held = Account(0.0, None, {a: w for a, (w, _) in book.items()}, facts)
    flags = sorted({f for a in book for f in facts[a]["flags"]})
    return to, {"gross_return": gross, "cost_return": cost, "turnover": turnover, "trades": trades, "rejected": left_out, "flags": flags, **_exposure(held)}


def step(account: Account, event: dict, rules: Rules) -> tuple[Account, dict]:
    """(the account after the event, the outcome's row). An event that is earlier than the last one, of an unknown kind or without a
    safe way is refused: its status says why and the account stays as it is. A leg without a price and volume is no market row; one
    without a target no intent; of legs of one asset the last counts."""
    did: dict = {}
    try:
        if event["kind"] not in KINDS:
            raise Refused("unknown_kind")
        if event["at"] is None or account.last is not None and event["at"] < account.last:
            raise Refused("time_order")
        event = event | {"legs": [x for x in event["legs"] or [] if x is not None and x["asset_id"] is not None]}
        if event["kind"] != "snapshot":
            account, did = {"rebalance": _rebalance, "mark": _mark, "round_trip": _round_trip}[event["kind"]](account, event, rules)
        status = "ok"
    except Refused as why:
        status = f"refused: {why}"
    row = {k: event[k] for k in ("account", "at", "seq", "kind")} | {"status": status, "equity": account.equity, "gross_return": 0.0, "cost_return": 0.0, "turnover": 0.0, "trades": [], "rejected": {}, "flags": []}
    return account, row | _exposure(account) | did | {"positions": account.held}


def _arrow() -> pa.Schema:
    trade = pa.struct([("asset_id", pa.string()), ("phase", pa.string()), *((c, pa.float64()) for c in ("previous", "target", "participation", "cost"))])
    kinds = {"account": pa.string(), "at": pa.timestamp("us", "UTC"), "seq": pa.int64(), "kind": pa.string(), "status": pa.string(), **dict.fromkeys(("equity", "gross_return", "cost_return", "turnover", "gross", "net", "beta"), pa.float64()),
             "trades": pa.list_(trade), "rejected": pa.map_(pa.string(), pa.list_(pa.string())), "flags": pa.list_(pa.string()), "positions": pa.map_(pa.string(), pa.float64())}
    return pa.schema(list(kinds.items()))


def outcomes(rows: list[dict]) -> pa.RecordBatch:
    """Rows of ``step`` as an Arrow batch of ``OUTCOME``."""
    return pa.RecordBatch.from_pylist([r | {c: list(r[c].items()) for c in ("rejected", "positions")} for r in rows], _arrow())


def replay(events: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The outcome of every event (``EVENT`` in, ``OUTCOME`` out): each account from its capital through its events by at, then seq.

    ``events`` may have a column ``capital``, an account's own start. Accounts are dealt to
    tasks and sorted there (Spark spills); a task holds one account and one batch, however
    long the account's history. Null accounts are an account; no events: no rows.
    """
    rules = rules or Rules()
    names = [c.split(" ")[0] for c in EVENT.split(", ")[:5]] + ["legs"]
    own = events.select(*names, F.coalesce(F.col("capital") if "capital" in events.columns else F.lit(None), F.lit(rules.capital)).cast("double").alias("capital"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, account = object(), Account(0.0)
        for batch in batches:
            rows = []
            for event in batch.to_pylist():
                if event["account"] != key:
                    key, account = event["account"], Account(event["capital"])
                account, row = step(account, event, rules)
                rows.append(row)
            yield outcomes(rows)

    return own.repartition("account").sortWithinPartitions("account", "at", "seq").mapInArrow(run, OUTCOME)
