"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, all of it, never a prefix. Each
passage is encoded (surface statistics, then a tanh layer); gated attention
tanh(Vh) * sigmoid(Uh) weighs the passages; the weighted mean is scored. All weights are
learned from document labels alone, in numpy, by Adam.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled

TRAIN_ROWS, PASSAGE, HIDDEN, GATE, EPOCHS, BATCH = 1500, 64, 16, 8, 60, 64


def passages(text: str | None) -> np.ndarray:
    """One row of surface statistics for each passage; an empty text is one passage of zeros."""
    words = (text or "").split()
    if not words:
        return np.zeros((1, WIDTH))
    seen: set[tuple[str, str]] = set()
    out, last = [], ""
    for a in range(0, len(words), PASSAGE):
        own = words[a : a + PASSAGE]
        joined = " ".join(own)
        n, m = len(own), len(joined)
        stripped = [w.rstrip(".,!?;:") for w in own]
        counts = Counter(stripped)
        pairs = list(zip(own, own[1:], strict=False))
        again = sum(p in seen for p in pairs)
        seen.update(pairs)
        letters = sum(map(str.isalpha, joined))
        upper = sum(map(str.isupper, joined))
        digits = sum(map(str.isdigit, joined))
        out.append((
            m / n / 10, (m - letters - digits - (n - 1)) / m, upper / m, digits / m, joined.count("|") / n, joined.count("!") / n,
            sum(not w[-1].isalnum() for w in own) / n, sum(w[-1] in "#$%&*" for w in own) / n, sum(w[-1] in ".?!" for w in own) / n, joined.count(",") / n,
            len(counts) / n, max(counts.values()) / n, sum(x == y for x, y in pairs) / n, again / n, sum(w[:1].isupper() for w in own) / n,
            sum(w.isupper() for w in own) / n, max(map(len, own)) / 30, float(own[0] == last), min(n, PASSAGE) / PASSAGE, np.log1p(len(words)) / 10,
            sum(len(w) <= 3 for w in own) / n, sum("http" in w or "@" in w or "=" in w for w in own) / n,
        ))
        last = own[-1]
    return np.array(out)


WIDTH = 22


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Attention:
    """Gated-attention pooling over bags given as one matrix and the first row of each bag."""

    def __init__(self, width: int = WIDTH, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.p = {"W": rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.25, (HIDDEN, GATE)),
                  "U": rng.normal(0, 0.25, (HIDDEN, GATE)), "a": rng.normal(0, 0.25, GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        p, sizes = self.p, np.diff(np.append(starts, len(x)))
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["a"]
        bag = np.repeat(np.arange(len(starts)), sizes)
        w = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        w /= np.add.reduceat(w, starts)[bag]
        z = np.add.reduceat(h * w[:, None], starts)
        return {"x": x, "h": h, "t": t, "s": s, "w": w, "bag": bag, "z": z, "y": _sigmoid(z @ p["c"] + p["d"][0])}

    def gradient(self, f: dict, y: np.ndarray, starts: np.ndarray) -> dict:
        p, n = self.p, len(y)
        g = (f["y"] - y) / n
        dz = g[:, None] * p["c"]
        dzb = dz[f["bag"]]
        inner = (dzb * f["h"]).sum(1)
        de = f["w"] * (inner - np.add.reduceat(f["w"] * inner, starts)[f["bag"]])
        dgate = de[:, None] * p["a"]
        dt, ds = dgate * f["s"] * (1 - f["t"] ** 2), dgate * f["t"] * f["s"] * (1 - f["s"])
        dh = (dzb * f["w"][:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "a": ((f["t"] * f["s"]) * de[:, None]).sum(0),
                "c": f["z"].T @ g, "d": np.array([g.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, l2: float = 1e-4, seed: int = 11) -> Attention:
        everything = np.vstack(bags)
        self.mean, self.scale = everything.mean(0), everything.std(0) + 1e-3
        rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for a in range(0, len(order), BATCH):
                own = order[a : a + BATCH]
                x = np.vstack([bags[i] for i in own])
                starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in own])[:-1]]).astype(int)
                g = self.gradient(self.forward(x, starts), y[own], starts)
                step += 1
                for k in self.p:
                    d = g[k] + l2 * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
                    self.p[k] = self.p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(int)
        return self.forward(np.vstack(bags), starts)["y"]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Attention:
    """Learned from at most ``rows`` documents of each label, none held out. Without labels
    the scores are 0.5. Classes keep their weight: the intercept is moved to the share of
    label 1 among all labelled rows that are not held out."""
    sample = labelled(docs, labels, "quality", rows)
    model = Attention()
    if not sample:
        return model
    y = np.array([l for _, l in sample], dtype=float)
    if 0 < y.mean() < 1:
        model.fit([passages(t) for t, _ in sample], y)
    own = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    clip = lambda q: min(max(q, 0.02), 0.98)
    odds = lambda q: np.log(clip(q) / (1 - clip(q)))
    model.p["d"] = model.p["d"] + (odds(own) - odds(y.mean()) if 0 < y.mean() < 1 else odds(y.mean()))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document.

    Null and empty texts are one passage of zeros. Repeated rows are each scored; of
    repeated labels the larger counts, null ones are left out. Without labels every score
    is 0.5; an empty table of documents gives no rows. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                s = sent.value.scores([passages(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
