"""Streaming extension: sliding attention windows with late data, first-seen novelty, and a stateful event fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attention(signals: DataFrame, width: str = "3 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """asset_id, window, n, sentiment_mean over sliding windows of availability; later than the watermark is dropped."""
    g = signals.withWatermark("available_at", late).groupBy("asset_id", F.window("available_at", width, slide))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("sentiment").alias("sentiment_mean"))


def sessions(signals: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Bursts of signals of an asset, closed by a gap."""
    return signals.withWatermark("available_at", late).groupBy("asset_id", F.session_window("available_at", gap)).agg(F.count(F.lit(1)).alias("n"))


def novel(signals: DataFrame, key: list[str], late: str = "7 days") -> DataFrame:
    """The first signal of each key within the watermark."""
    return signals.withWatermark("available_at", late).dropDuplicatesWithinWatermark(key)


def fold(events: DataFrame, key: str, kind: str, transitions: dict[tuple[str, str], str], start: str) -> DataFrame:
    """key, state, n_events after each micro-batch: the state machine of a log, its state kept between batches."""
    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else (start, 0)
        for b in batches:
            for e in b.sort_values("seq")[kind]:
                now, n = transitions.get((now, e), now), n + 1
        state.update((now, n))
        yield pd.DataFrame({key: [k[0]], "state": [now], "n_events": [n]})

    kind_of = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind_of}, state string, n_events long", "state string, n long", "update", "NoTimeout")
