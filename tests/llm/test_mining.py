"""Hard negatives against a plain version; the bounds of the codes."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mining


def plain(rows, scale=256, positives=5, negatives=3):
    ok = {}
    for i, v, y in sorted((r for r in rows if None not in (r[0], r[1], r[2]) and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[1], r[2]), reverse=True):
        ok[i] = (y, [math.floor(Fraction(scale) * Fraction(x)) for x in v])
    clip = lambda s: max(min(s, 2**63 - 1), -(2**63))
    out = set()
    for a in (i for i in ok if i % 50 == 0):
        best = sorted((-sum(p * w for p, w in zip(ok[a][1], v)), i) for i, (y, v) in ok.items() if i != a)
        for p, j in [b for b in best if ok[b[1]][0] == ok[a][0]][:positives]:
            own = [(s, i) for s, i in best if ok[i][0] != ok[a][0] and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out |= {(a, j, r + 1, i, clip(-p), clip(-s)) for r, (s, i) in enumerate(own)}
    return out


def mined(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, "x", "c") for r in rows], "vec_id long, embedding array<double>, label int, score string, i string").repartition(parts)
    return {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in mining.hard_negatives(df, F.col("i") % 50 == 0, **more).collect()}


@pytest.mark.parametrize("kind", ["clusters", "ties", "noise", "wide", "huge"])
def test_against_plain(spark, kind):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(320):
        c = i % 9
        v = rng.normal(0, 1, 6) * (0.2 if kind == "clusters" else 1) + (np.eye(9, 6)[c] if kind == "clusters" else 0)
        if kind == "ties":
            v = np.round(v)
        if kind == "wide":
            v = rng.normal(0, 1, int(rng.integers(1, 9)))
        if kind == "huge":
            v = v * 10.0 ** rng.integers(-3, 40)
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 4))))
    rows += [(400, None, 1), (401, [1.0], None), (402, [1.0, None], 1), (403, [float("nan")], 1), (404, [float("inf")], 1), (None, [1.0], 1), (7, rows[7][1], 3), (50, rows[50][1], rows[50][2]), (450, [0.0] * 6, 1), (500, [], 2)]
    assert mined(spark, rows, group_bytes=200, fit_rows=90, centroids=16, stretch=2) == plain(rows)


def test_many_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(mining, "BLOCK", 64)
    monkeypatch.setattr(mining, "TILE", 3)
    monkeypatch.setattr(mining, "PAIRS", 50)
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (30, 8))
    rows = [(i, [float(x) for x in base[rng.integers(0, 30) if rng.random() < 0.6 else 0] + (rng.normal(0, 0.05, 8) if rng.random() < 0.5 else 0)], int(rng.integers(0, 3))) for i in range(1500)]
    assert mined(spark, rows) == plain(rows)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(0, 0.12, (2000, 64)))
    book = mining.codebook(x[:500])
    codes, norms = mining._encode(x, book)
    looked = sum(np.take(x[:40, 2 * s : 2 * s + 2] @ book[s].T, codes[:, s], axis=1) for s in range(32))
    parts = np.sqrt((x[:40].reshape(40, 32, 2) ** 2).sum(2))
    bound, true = parts @ norms[:, :32].T, x[:40] @ x.T
    assert (np.abs(true - looked) <= bound + 1e-6).all()
    assert np.median(bound) < 0.8 * np.std(true)


def test_empty(spark):
    assert mined(spark, []) == set() and mined(spark, [(0, [1.0], 1)]) == set() and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == set()
