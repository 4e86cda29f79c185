"""Periodic runs against a plain search of all lags and positions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from test_llm_operators import awkward, empty

from tidemark.llm import periodic


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)  # lags come in order: the first is the smallest period
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items() if not any(q % p == 0 and p < q and a <= s and s + length <= a + m for (a, m), p in found.items()))


def plain_digest(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def made(rng, n, letters):
    """Codes with runs of many periods, one inside or behind another."""
    out = []
    while len(out) < n:
        unit = [rng.randrange(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 40]))]
        out += unit * rng.choice([1, 1, 2, 4, 9, 30]) + unit[: rng.randrange(len(unit) + 1)]
        if rng.random() < 0.2 and out:
            out += out[-rng.randrange(1, len(out) + 1) :] * rng.choice([1, 2, 3])
    return out[:n]


@pytest.mark.parametrize("share", [0.0, 0.1, 1e9])  # all words frequent, as in use, all rare
def test_runs(monkeypatch, share):
    monkeypatch.setattr(periodic, "PAIRS_A_POINT", share)
    rng = random.Random(5)
    for k in range(250):
        codes = made(rng, rng.choice([5, 23, 24, 25, 60, 200, 500]), rng.choice([1, 2, 3, 10, 300]))
        assert periodic.find(np.array(codes)) == plain_runs(codes), (k, codes)


def test_lag_counts(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 50)
    rng = np.random.default_rng(4)
    codes = np.minimum(rng.zipf(1.3, 700) - 1, 300)
    assert periodic.lag_matches(codes, 233).tolist() == [0] + [int((codes[:-q] == codes[q:]).sum()) for q in range(1, 234)]


def test_very_long_texts():
    assert periodic.find(np.zeros(300_000, int)) == [(0, 300_000, 1)]
    rng = np.random.default_rng(1)
    two = np.concatenate([rng.integers(0, 2, 60_000), np.tile(rng.integers(0, 5000, 20_000), 4)])
    assert (60_000, 80_000, 20_000) in [(s, m, p) for s, m, p in periodic.find(two) if p == 20_000]


def test_with_runs(spark):
    text = "lead " + "a b c " * 9 + "tail\tend"
    df = spark.createDataFrame([(1, text, "kept"), (2, None, None), (1, text, "kept")], "doc_id long, text string, periodic string")
    got = periodic.with_runs(df, to="found").orderBy("doc_id").collect()
    assert [tuple(r) for r in got[0].found.runs] == [(1, 27, 3)] and got[0].found.collapsed == "lead a b c tail end" and got[0].periodic == "kept"
    assert got[2].found.runs == [] and got[2].found.collapsed == "" and len(got) == 3


def test_digest_against_plain(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{c}" for c in made(rng, rng.choice([0, 1, 2, 30, 200]), rng.choice([2, 20, 200])))) for i in range(120)] + [(None, "x " * 50), (None, None), (27, None), (27, " \t\n")]
    few = awkward(spark).where("text IS NULL OR length(text) < 40000")  # the plain version is quadratic
    odd = [(r.doc_id, r.text) for r in few.collect()]
    for df, want in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (few, odd)):
        got = [tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in periodic.digest(df).collect()]
        assert sorted(got, key=repr) == sorted((plain_digest(*r) for r in want), key=repr)
    assert periodic.digest(empty(spark)).count() == 0
