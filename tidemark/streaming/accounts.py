"""Paper accounts over a stream: one account a key, its equity and positions typed state that a checkpoint resumes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.accounts import OUTCOME, OUTCOME_COLUMNS, Account, Rules, step

#: An account, and each asset that it knows; a weight of 0 is not held.
ACCOUNT = "equity double, last timestamp"
ASSET = "weight double, price double, dollar_volume double, sector string, beta double, volatility double, short_available boolean, hard_to_borrow boolean, flags array<string>"


def _plain(leg: object) -> dict:
    return leg.asDict() if hasattr(leg, "asDict") else dict(leg)


class PaperAccounts(StatefulProcessor):
    """Carries the events of a micro-batch out in order; what a later batch brings for an earlier time is refused, as in a batch replay."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.account = handle.getValueState("account", ACCOUNT)
        self.assets = handle.getMapState("assets", "asset_id string", ASSET)

    def _load(self) -> Account:
        if not self.account.exists():
            return Account(self.rules.capital)
        equity, last = self.account.get()
        names = [c.split()[0] for c in ASSET.split(", ")]
        known = {key[0]: dict(zip(names, value, strict=True)) for key, value in self.assets.iterator()}
        held = {a: f.pop("weight") for a, f in known.items()}
        return Account(equity, None if last is None else pd.Timestamp(last), {a: w for a, w in held.items() if w}, {a: f | {"flags": list(f["flags"])} for a, f in known.items() if f["price"] is not None})

    def _save(self, before: Account, after: Account) -> None:
        """Writes the assets that changed."""
        self.account.update((after.equity, after.last))
        blank = {"price": None, "dollar_volume": None, "sector": None, "beta": None, "volatility": None, "short_available": None, "hard_to_borrow": None, "flags": []}
        for a in {*before.held, *after.held, *after.known}:
            now = (after.held.get(a, 0.0), after.known.get(a))
            if now != (before.held.get(a, 0.0), before.known.get(a)):
                self.assets.updateValue((a,), (now[0], *(now[1] or blank).values()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        before = account = self._load()
        out = []
        for event in pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable").to_dict("records"):  # one micro-batch of one account
            event |= {"account": key[0], "at": None if pd.isna(event["at"]) else event["at"], "legs": [_plain(x) for x in (event["legs"] if event["legs"] is not None else [])]}
            account, row = step(account, event, self.rules)
            out.append(row)
        self._save(before, account)
        yield pd.DataFrame(out)[OUTCOME_COLUMNS]

    def close(self) -> None:
        pass


def paper_accounts(events: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The outcome of every event, batch after batch; needs the RocksDB state store.

    ``events`` as in ``tidemark.operators.accounts.replay``, of which every account starts with ``rules.capital``.
    """
    return events.groupBy("account").transformWithStateInPandas(PaperAccounts(rules or Rules()), OUTCOME, "Append", "None")
