"""Masked pseudo-likelihood from bidirectional window networks trained in numpy.

Every word is masked in turn and predicted from two words to each side, in two factors:

* p(class | window): the ``TOP`` most frequent words are classes of their own, the others
  fall into ``HASHED`` classes. Two networks (an embedding for each side, a tanh layer, a
  softmax over all classes) look at the nearest and at the second nearest pair of
  neighbours and are mixed by how well they predict. The counts of (left, masked, right)
  over every document are all that their training needs; they are gathered exactly.
* p(word | class): from the counts of all words of the corpus. Those of the most frequent
  words (all that occur a number of times, up to ``VOCABULARY`` words) are part of the
  model; every other word meets its count by a shuffle. For these, what a document
  itself holds does not count: a masked document does not vouch for its own words.

A document's score is the sum of the logarithms over all of its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, meet, settle

TOP, HASHED, EMBED, HIDDEN, STEPS = 79, 48, 12, 24, 150
CLASSES = TOP + HASHED + 1
EDGE = CLASSES - 1
#: Distances of the pairs of neighbours that the networks see.
REACH = (1, 2)
#: Words that travel with the model at most (some 20 bytes each); all others are as exact, by a shuffle.
VOCABULARY = 200_000
#: Codes from here on stand for words beyond the vocabulary: 62 bits of their hash.
RARE = 1 << 62
#: What a word beyond the vocabulary counts besides its other occurrences; below 1, so no class is given away twice.
PRIOR = 0.5
#: Distinct words that a task counts before it passes them on, and words whose codes it remembers.
HELD = 400_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def word_counts(docs: DataFrame) -> DataFrame:
    """w (UTF-8 bytes of a lower-case word), n: over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])
            counts.clear()
            return out

        for b in batches:
            for t in b.column(0):
                counts.update(words_of(t.as_py()))
                if len(counts) > HELD:
                    yield emit()
        yield emit()

    return gathered(docs).select("text").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def vocabulary(counted: DataFrame, most: int = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """The words that occur at least as often as lets no more than ``most`` words in, and their counts; most frequent first, ties by word."""
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.pow(F.lit(2.0), F.floor(F.log2("n") * 64) / 64))).cast("long")
    least, room = None, most
    for r in counted.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("s")).collect():  # some 1024 + 64 * 53 rows at most
        if r["k"] > room:
            break
        least, room = r["s"], room - r["k"]
    if least is None:
        return [], np.zeros(0, dtype=np.int64)
    got = counted.where(step >= least).toArrow()  # at most ``most`` rows
    rows = sorted(zip((-got["n"].to_numpy()).tolist(), got["w"].to_pylist(), strict=True))
    return [w for _, w in rows], np.array([-n for n, _ in rows], dtype=np.int64)


class Codes(dict):
    """word -> its number in the vocabulary, or ``RARE`` plus a hash; the classes of codes."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(vocabulary))
        self.most = len(vocabulary) + HELD
        self.classes = np.array([i if i < TOP else TOP + self.hashed(w) % HASHED for i, w in enumerate(vocabulary)] or [0], dtype=np.int64)

    @staticmethod
    def hashed(w: bytes) -> int:
        return xxhash.xxh64_intdigest(w) & (RARE - 1)

    def __missing__(self, w: bytes) -> int:
        code = RARE + self.hashed(w)
        if len(self) < self.most:
            self[w] = code
        return code

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def classes_of(self, codes: np.ndarray) -> np.ndarray:
        rare = codes >= RARE
        return np.where(rare, TOP + (codes - RARE) % HASHED, self.classes[np.where(rare, 0, codes)])


def _contexts(c: np.ndarray, reach: int) -> np.ndarray:
    """left * C * C + masked * C + right for each class, neighbours ``reach`` away; edges stand in beyond both ends."""
    edge = np.full(reach, EDGE)
    left, right = np.concatenate([edge, c])[: len(c)], np.concatenate([c, edge])[reach:]
    return (left * CLASSES + c) * CLASSES + right


def count_contexts(docs: DataFrame, words: list[bytes]) -> np.ndarray:
    """Counts over all documents as an array [reach, left, masked, right]; bounded by 2 * CLASSES ** 3."""
    sent, cells = docs.sparkSession.sparkContext.broadcast(words), CLASSES**3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = Codes(sent.value), np.zeros(cells * len(REACH), dtype=np.int64)
        for b in batches:
            own = [codes.classes_of(c) for t in b.column(0) if len(c := codes.of(t.as_py()))]
            for a in range(0, len(own), 256):
                for k, reach in enumerate(REACH):
                    total[k * cells : (k + 1) * cells] += np.bincount(np.concatenate([_contexts(c, reach) for c in own[a : a + 256]]), minlength=cells)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 100_000], pa.int32()), pa.array(total[at[a : a + 100_000]])], names=["k", "n"])

    counted = gathered(docs).select("text").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    out = np.zeros(cells * len(REACH))
    got = counted.toArrow()  # at most 2 * CLASSES ** 3 rows
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(len(REACH), CLASSES, CLASSES, CLASSES)


class WindowNetwork:
    """p(masked | left, right) = softmax(tanh(L[left] A + R[right] B + h0) O + o)."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        init = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        self.p = {"L": init(CLASSES, EMBED), "R": init(CLASSES, EMBED), "A": init(EMBED, HIDDEN), "B": init(EMBED, HIDDEN), "h0": np.zeros(HIDDEN, np.float32),
                  "O": init(HIDDEN, CLASSES), "o": np.zeros(CLASSES, np.float32)}

    def _forward(self):
        p = self.p
        h = np.tanh((p["L"] @ p["A"])[:, None, :] + (p["R"] @ p["B"])[None, :, :] + p["h0"]).reshape(-1, HIDDEN)
        z = h @ p["O"] + p["o"]
        z -= z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, counts: np.ndarray, steps: int = STEPS, rate: float = 0.03) -> WindowNetwork:
        """Full-batch Adam on the mean conditional log-probability of all tokens counted."""
        total = counts.sum()
        if not total:
            return self
        target = (counts.transpose(0, 2, 1).reshape(-1, CLASSES) / total).astype(np.float32)
        self.p["o"] = np.log(target.sum(0) + np.float32(1e-6))
        weight, m, v = target.sum(1, keepdims=True), {}, {}
        for step in range(1, steps + 1):
            p = self.p
            h, logp = self._forward()
            dz = weight * np.exp(logp) - target
            dh = (dz @ p["O"].T * (1 - h * h)).reshape(CLASSES, CLASSES, HIDDEN)
            by_left, by_right = dh.sum(1), dh.sum(0)
            g = {"O": h.T @ dz, "o": dz.sum(0), "h0": by_left.sum(0), "A": p["L"].T @ by_left, "L": by_left @ p["A"].T, "B": p["R"].T @ by_right, "R": by_right @ p["B"].T}
            for k in p:
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g[k]
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g[k] ** 2
                p[k] = (p[k] - rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)).astype(np.float32)
        return self

    def table(self) -> np.ndarray:
        """log p[left, masked, right], flat: the network run on every context once."""
        logp = self._forward()[1].reshape(CLASSES, CLASSES, CLASSES)
        return logp.transpose(0, 2, 1).reshape(-1).astype(np.float64)


class Model:
    """What scoring needs: the vocabulary, log p(word | class) of its words, p(class | window) and how often each class occurs."""

    def __init__(self, words: list[bytes], n: np.ndarray, counts: np.ndarray) -> None:
        self.words, self.often = words, counts[0].sum(axis=(0, 2))
        classes = Codes(words).classes
        self.log_word = np.log(n / np.maximum(1, self.often[classes[: len(n)]])) if len(n) else np.zeros(1)
        tables = [WindowNetwork().fit(c).table() for c in counts]
        total = max(1.0, counts[0].sum())
        fit = np.array([(c.reshape(-1) @ t) / total for c, t in zip(counts, tables, strict=True)])  # mean log-probability of the corpus
        self.share = np.exp(fit - fit.max()) / np.exp(fit - fit.max()).sum()
        self.tables = [(s * np.exp(t)).astype(np.float32) for s, t in zip(self.share, tables, strict=True)]

    def known(self, codes: np.ndarray, classes: np.ndarray) -> float:
        """log p(class | window) of all words and log p(word | class) of those in the vocabulary, summed up."""
        p = sum(t[_contexts(classes, reach)] for t, reach in zip(self.tables, REACH, strict=True))
        return float(np.log(np.maximum(p, 1e-30)).sum(dtype=np.float64) + self.log_word[codes[codes < RARE]].sum())


def score_documents(docs: DataFrame, most: int = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_unseen, log_likelihood, mean_log_likelihood (null for a text without words): one row per document.

    log_likelihood sums log p(word | both sides) over all words; n_unseen counts the words
    that no other document holds. Null text counts as empty; repeated rows are documents of
    their own, in training as well; an empty table gives no rows; other columns are ignored.
    """
    spark, docs = docs.sparkSession, gathered(docs)
    words, n = vocabulary(settle(word_counts(docs)), most)
    model = Model(words, n, count_contexts(docs, words))
    sent = spark.sparkContext.broadcast(model)  # two tables of CLASSES ** 3 floats and the vocabulary: some 25 MB at any input size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        codes = Codes(model.words)
        for b in batches:
            n, s, starts, hashes, times = [], [], [0], [], []
            for t in b.column(2):
                c = codes.of(t.as_py())
                n.append(len(c))
                s.append(model.known(c, codes.classes_of(c)) if len(c) else 0.0)
                h, f = np.unique(c[c >= RARE], return_counts=True)
                hashes.append(h)
                times.append(f)
                starts.append(starts[-1] + len(h))
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *x]), pa.int64())) for x in (hashes, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(s, pa.float64()), *lists], names=["doc_id", "uid", "n_tokens", "s", "h", "f"])

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    scored = settle(docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), "text").mapInArrow(score, f"doc_id {kind}, uid long, n_tokens long, s double, h array<bigint>, f array<bigint>"))
    # Words beyond the vocabulary meet their counts; none of them is frequent enough to be in it.
    rare = scored.select("uid", F.explode(F.arrays_zip("h", "f")).alias("x")).select("uid", "x.h", "x.f")
    totals = rare.groupBy("h").agg(F.sum("f").alias("n"), F.count(F.lit(1)).alias("k"))
    often = F.element_at(F.array(*(F.lit(float(max(1.0, x))) for x in model.often[TOP:EDGE])), ((F.col("h") - RARE) % HASHED + 1).cast("int"))
    other = F.col("n") - F.col("f")
    each = meet(rare, totals, "h", "k").groupBy("uid").agg(F.sum(F.col("f") * F.log((other + PRIOR) / often)).alias("r"), F.sum(F.when(other == 0, F.col("f")).otherwise(0)).alias("n_unseen"))
    joined = scored.select("doc_id", "uid", "n_tokens", "s").join(each, "uid", "left")
    log_likelihood = F.col("s") + F.coalesce("r", F.lit(0.0))
    return joined.select("doc_id", "n_tokens", F.coalesce("n_unseen", F.lit(0).cast("long")).alias("n_unseen"), log_likelihood.alias("log_likelihood"),
                         F.try_divide(log_likelihood, F.col("n_tokens").cast("double")).alias("mean_log_likelihood"))
