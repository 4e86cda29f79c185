"""Resampling, seeded orders and sequential replay: what needs a state or a random generator runs per group in pandas."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import holm
from ..functions.costs import CostModel
from .portfolio import Limits


def block_bootstrap(rows: DataFrame, by: list[str], order: str, block: int, replicates: int, seed: int) -> DataFrame:
    """by, n, mean, low, high (2.5 and 97.5 % order statistics of the mean) and a centred two-sided p-value.

    Moving blocks of ``block`` consecutive values; a group is one series of period results.
    """
    def run(own: pd.DataFrame) -> pd.DataFrame:
        v = own.sort_values(order)["value"].to_numpy(float)
        n, mean, rng = len(v), float(v.mean()), random.Random(seed)
        size = max(1, min(block, n))
        starts = np.array([[rng.randrange(n - size + 1) for _ in range(-(-n // size))] for _ in range(replicates)])
        means = np.sort(v[(starts[:, :, None] + np.arange(size)).reshape(replicates, -1)[:, :n]].mean(1))
        extreme = int((np.abs(means - mean) >= abs(mean)).sum())
        at = lambda q: float(means[int(q * (replicates - 1))])
        return pd.DataFrame({**{k: [own[k].iloc[0]] for k in by}, "n": [n], "mean": [mean], "low": [at(0.025)], "high": [at(0.975)], "p_value": [(extreme + 1) / (replicates + 1)]})

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)
    return rows.groupBy(*by).applyInPandas(run, f"{kinds}, n long, mean double, low double, high double, p_value double")


def compare(results: DataFrame, by: list[str], order: str, block: int, replicates: int, seed: int) -> DataFrame:
    """by, observations, effect, low, high, p_value, negative, holm_p_value: candidate against control, period by period.

    ``results``: candidate and control net returns of each period. Holm's adjustment is over all
    groups, ties in the order of ``by``; a group of one period has an interval of one point.
    """
    differences = results.select(*by, order, (F.col("candidate") - F.col("control")).alias("value"))
    one = block_bootstrap(differences, by, order, block, replicates, seed)
    everything = Window.partitionBy(F.lit(0))  # one row a group
    step, place = holm(F.col("p_value"), everything.orderBy("p_value", *by), everything)
    ranked = one.withColumns({"_step": step, "_place": place})
    return ranked.select(*by, F.col("n").alias("observations"), F.col("mean").alias("effect"), "low", "high", "p_value", (F.col("mean") <= 0).alias("negative"),
                         F.max("_step").over(everything.orderBy("_place")).alias("holm_p_value"))


def seeded_shuffle(rows: DataFrame, by: list[str], order: str, value: str, seed: int) -> DataFrame:
    """``rows`` with the values of each group permuted, in the order of ``order``.

    Python's generator is seeded with the first eight bytes of sha256("seed|key|key..."), so a
    group's permutation depends on nothing but its key.
    """
    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order)
        values = own[value].tolist()
        digest = hashlib.sha256("|".join(map(str, (seed, *key))).encode()).digest()
        random.Random(int.from_bytes(digest[:8], "big")).shuffle(values)
        return own.assign(**{value: values})

    return rows.groupBy(*by).applyInPandas(run, rows.schema)


def replay(rows: DataFrame, k: int, limits: Limits, costs: CostModel, equity: float) -> DataFrame:
    """family, ts, equity, net_return, trades: decisions in time order; the participation limit uses the equity so far.

    The k largest scores of a decision do not depend on the equity, so they are chosen before; one
    task then holds k rows a decision of one family.
    """
    first = Window.partitionBy("family", "ts").orderBy(F.desc(F.abs("score")), "asset_id")
    rows = rows.where("score <> 0").withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= k)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        now, out = equity, []
        for ts, d in own.sort_values(["ts", "asset_id"]).groupby("ts", sort=True):
            w = np.sign(d["score"].to_numpy()) * min(limits.max_position_weight, limits.max_gross_exposure / max(1, len(d)))
            most = limits.max_participation_rate * d["dollar_volume"].to_numpy() / max(now, 1e-12)
            w = np.sign(w) * np.minimum(np.abs(w), most)
            gross = float((w * d["forward_return"].to_numpy()).sum())
            cost = float(np.abs(w).sum()) * 2 * (costs.commission_bps + costs.half_spread_bps + costs.slippage_bps) / 1e4
            now *= max(0.0, 1 + gross - cost)
            out.append((own["family"].iloc[0], ts, now, gross - cost, int((np.abs(w) > 1e-12).sum())))
        return pd.DataFrame(out, columns=["family", "ts", "equity", "net_return", "trades"])

    return rows.select("family", "ts", "asset_id", "score", "dollar_volume", "forward_return").groupBy("family").applyInPandas(run, "family string, ts date, equity double, net_return double, trades int")


