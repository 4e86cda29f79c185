"""Periodic runs of words, by counting lags heavy and light.

For every lag the number of words that equal the word so far behind them is counted
exactly: frequent words by the autocorrelation of their indicators (one FFT each, spectra
added, one inverse), rare words by the differences of all their positions. A run of
period q has at least ``max(24, 3q) - q`` equal words in a row at lag q, so lags with
fewer matches hold none; matches that runs of a divisor of q account for are taken off
first. Only the lags that are left are scanned for islands of matches.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import count, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, by_text

#: A run has at least so many words and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Pairs of positions that are expanded at once.
PAIRS = 2**20
#: A word is frequent if its pairs cost more than its transform: pairs for each point and doubling of the transform.
PAIRS_A_POINT = 0.1

RUN = "struct<start: bigint, length: bigint, period: bigint>"
RESULT = f"struct<runs: array<{RUN}>, collapsed: string>"


def lag_matches(codes: np.ndarray, lags: int) -> np.ndarray:
    """``out[q]``: how many words equal the word q before them, for q up to ``lags``; ``codes`` numbers the words by any integers from 0 below their count."""
    n = len(codes)
    points = 1 << (n + lags - 1).bit_length()  # long enough that nothing wraps round onto these lags
    counts = np.bincount(codes)
    heavy = np.flatnonzero(counts.astype(np.float64) ** 2 > 2 * PAIRS_A_POINT * points * points.bit_length())
    out = np.zeros(lags + 1, dtype=np.int64)
    if len(heavy):
        power = np.zeros(points // 2 + 1)
        for code in heavy:
            spectrum = np.fft.rfft(codes == code, points)
            power += spectrum.real**2 + spectrum.imag**2
        out += np.rint(np.fft.irfft(power, points)[: lags + 1]).astype(np.int64)  # counts are whole: the rounding is exact
    order = np.argsort(codes, kind="stable")
    if len(heavy):
        order = order[~np.isin(codes[order], heavy)]
        counts[heavy] = 0
    held = counts[counts > 0]
    later = np.repeat(np.cumsum(held), held) - np.arange(len(order)) - 1  # positions of the same word that follow
    ends = np.cumsum(later)
    a = 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        own = later[a:b]
        first = np.repeat(np.arange(a, b), own)
        step = np.arange(len(first)) - np.repeat(np.cumsum(own) - own, own) + 1
        gap = order[first + step] - order[first]
        out += np.bincount(gap[gap <= lags], minlength=lags + 1)
        a = b
    out[0] = 0
    return out


def _islands(codes: np.ndarray, q: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, length) of stretches with period q and ``least`` or more matches at lag q in a row.

    Such an island holds at least ``least // step`` neighbouring multiples of ``step``, so
    only multiples that match, with their neighbours, are looked at closely.
    """
    n, step = len(codes), max(1, least // 2)
    at = np.arange(0, n - q, step)
    hit = codes[at] == codes[at + q]
    at = at[hit & (np.append(hit[1:], False) | np.append(False, hit[:-1]))]
    for look in (step // 2, step // 4, step // 8):  # a match half-way to a neighbour, too
        if len(at) < 64 or not look:
            break
        near = np.clip(at[:, None] + np.array([-look, look]), 0, n - q - 1)
        at = at[(codes[near] == codes[near + q]).any(axis=1)]
    end = -1
    for i in at.tolist():
        if i < end:
            continue
        a = b = i
        for size in (64 * 4**k for k in count()):  # to the right, by ever longer pieces
            same = codes[b : min(b + size, n - q)] == codes[b + q : min(b + size, n - q) + q]
            if not len(same):
                break
            b += len(same) if same.all() else int(np.argmin(same))
            if not same.all():
                break
        for size in (64 * 4**k for k in count()):
            lo = max(0, a - size)
            same = (codes[lo:a] == codes[lo + q : a + q])[::-1]
            if not len(same):
                break
            a -= len(same) if same.all() else int(np.argmin(same))
            if not same.all():
                break
        end = b
        if b - a >= least:
            yield a, b - a + q


def find(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(codes)
    lags = n // LEAST_PERIODS
    if n < LEAST_WORDS or not lags:
        return []
    matches = lag_matches(codes, lags)
    q = np.arange(lags + 1)
    least = np.maximum(LEAST_WORDS, LEAST_PERIODS * q) - q
    runs: list[tuple[int, int, int]] = []
    lengths: dict[int, list[int]] = {}  # by period, longest first
    for lag in np.flatnonzero(matches >= least).tolist():
        # Runs of two divisors of a lag overlap by less than the lag, so their matches at it are different ones.
        divisors = [p for p in lengths if lag % p == 0]
        known = sum(length - lag for p in divisors for length in takewhile(lag.__lt__, lengths[p]))
        if matches[lag] - known < least[lag]:
            continue
        found = [(start, length, lag) for start, length in _islands(codes, lag, int(least[lag]))]
        if divisors:  # islands within a run of a divisor have that period
            own = {p: [r for r in runs if r[2] == p] for p in divisors}
            found = [r for r in found if not any((i := bisect_right(own[p], (r[0], n, n))) and own[p][i - 1][0] + own[p][i - 1][1] >= r[0] + r[1] for p in divisors)]
        if found:
            runs += found
            lengths[lag] = sorted((length for _, length, _ in found), reverse=True)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """Without the words that follow the first period of a run."""
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join(words if kept.all() else [words[i] for i in np.flatnonzero(kept)]).decode()


def _search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])
    for batch in texts:
        out = []
        for text in batch.cast(pa.binary()):
            words = (text.as_py() or b"").split()
            number: dict[bytes, int] = {}
            # A word's number is the place where it comes first.
            codes = np.fromiter(map(number.setdefault, words, count()), dtype=np.int64, count=len(words)) if len(words) >= LEAST_WORDS else None
            runs = find(codes) if codes is not None and len(number) < len(codes) else []
            out.append({"runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "collapsed": _collapsed(words, runs)})
        yield pa.array(out, kind)


def with_runs(docs: DataFrame, text: str = "text", to: str = "periodic") -> DataFrame:
    """``docs`` with a column ``to``: the runs of each text and the text with its runs cut to their first period.

    A word is a stretch of other bytes than ASCII white space. Null, empty and short texts
    have no runs; the collapsed text of null is empty; white space becomes one space. A run
    that several rows hold is found in each. Texts of any length are searched whole; an empty
    table gives none. Other columns, whatever their names, stay; one named ``to`` is replaced.
    """
    return docs.withColumn(to, by_text(_search, RESULT)(F.col(text)))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which one document in ten repeats a part to its end.

    With h = crc32(doc_id as text; null: '') and g = h div 10, texts of h % 10 = 0 become
    their n words with one space between, where word i >= a is replaced by word
    a + (i - a) % p, a = g % n, p = 1 + (n - a) div (3 + g % 8). Other texts, null and
    texts without words stay as they are.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"[^{SPACES}]+"), F.lit(0)))
    cut = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g"))
    cut = cut.withColumn("n", F.size("w")).withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    # No lambda functions here: Spark does not hand their values on to Python in the same step.
    again = F.expr("slice(flatten(array_repeat(slice(w, cast(a + 1 as int), cast(p as int)), cast((n - a) div p + 1 as int))), 1, cast(n - a as int))")
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(w, 1, cast(a as int))"), again), " ")).otherwise(F.col("text")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exact exponent, and digests of all runs and of the collapsed text.

    Ties go to the smallest start, then period; without runs start, length, period and
    exponent_milli are null. Every row of ``docs`` gives one row; texts as in ``with_runs``.
    """
    found = with_runs(planted(docs)).select("doc_id", "periodic.*")
    # length / period compared by products; runs come by start, then period, so the first of equals stays.
    best = F.reduce("runs", F.lit(None).cast(RUN), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
