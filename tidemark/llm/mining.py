"""Hard negatives by product quantisation with stored residual norms.

A vector of integers is a sum of centroids, one for each stretch of components, and a
residual. Stored are the centroids' numbers and the residual's norm in each stretch, so the
inner product with an anchor lies within (sum of looked-up scores) +- (sum of the products of
norms): no candidate outside that interval is lost. What the intervals leave over is scored
again by exact integers, which completes the positives of each anchor and the window of
each positive. The codebook may come from a sample: it changes how much is scored again, never the result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, settle
from .topk import _spread, _weights

#: Components of a stretch, centroids of a stretch, rows that the codebook is fitted on at most, rounds of its fit.
STRETCH, CENTROIDS, FIT_ROWS, FIT_ROUNDS = 2, 256, 4096, 8
#: Rows of a stored block; anchors that are held against a block at once; pairs that are scored again at once.
BLOCK, TILE, PAIRS = 2048, 64, 2**16
#: Bytes of anchors (8 a component) that are sent at once.
GROUP_BYTES = 16 * 2**20
#: Ids (8 bytes each) that are broadcast at most; more meet by a shuffle.
BROADCAST_IDS = 500_000
FOUND = "anchor_id long, positive_id long, cap string, vec_id long, score string"


def _limit(width: int) -> int:
    """Components up to here give scores that doubles hold exactly, for vectors of up to ``width`` of them; larger ones are scored by Python's integers."""
    return min(2**20, math.isqrt(2**52 // max(1, width)))


def usable(rows: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """i, y, v of the rows that take part: label and id not null, every component finite; one row of each id, that with the smallest vector, then label."""
    df = rows.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("long").alias("y"), F.col(vector_col).cast("array<double>").alias("v"))
    df = df.where(F.col("i").isNotNull() & F.col("y").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    repeated = settle(df.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i"))  # shuffles ids alone
    n = repeated.limit(BROADCAST_IDS + 1).count()
    if not n:
        return df
    sent = F.broadcast(repeated) if n <= BROADCAST_IDS else repeated
    one = df.join(sent, "i", "left_semi").groupBy("i").agg(F.min(F.struct("v", "y")).alias("r")).select("i", "r.y", "r.v")
    return df.join(sent, "i", "left_anti").unionByName(one)


def codebook(sample: np.ndarray, stretch: int = STRETCH, centroids: int = CENTROIDS, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Centroids (stretch number, centroid, component) of whole numbers, by Lloyd's rounds from rows drawn with a fixed seed."""
    parts = -(-sample.shape[1] // stretch)
    sample = np.pad(sample, ((0, 0), (0, parts * stretch - sample.shape[1])))
    out = np.zeros((parts, centroids, stretch))
    for s in range(parts):
        x = sample[:, s * stretch : (s + 1) * stretch]
        own = np.unique(x, axis=0)
        c = own[np.random.default_rng(s).permutation(np.arange(max(centroids, len(own))) % len(own))[:centroids]]
        for _ in range(rounds):
            near = _nearest(x, c)
            n = np.bincount(near, minlength=centroids)
            for j in range(stretch):
                c[:, j] = np.where(n > 0, np.bincount(near, x[:, j], centroids) / np.maximum(n, 1), c[:, j])
        out[s] = np.rint(c)
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(1)[None, :] - 2 * (x @ c.T), axis=1) if len(x) else np.zeros(0, int)


def _encode(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the centroids, norms of the residuals) by row and stretch; what a vector has beyond the book's length is one more residual."""
    parts, _, stretch = book.shape
    wide = np.pad(x, ((0, 0), (0, max(0, parts * stretch - x.shape[1]))))
    codes, norms = np.zeros((len(x), parts), np.uint16), np.zeros((len(x), parts + 1))
    for s in range(parts):
        own = wide[:, s * stretch : (s + 1) * stretch]
        codes[:, s] = _nearest(own, book[s])
        norms[:, s] = np.sqrt(((own - book[s][codes[:, s]]) ** 2).sum(1))
    norms[:, parts] = np.sqrt((wide[:, parts * stretch :] ** 2).sum(1))
    return codes, norms


def stored(rows: DataFrame, scale: float, stretch: int = STRETCH, centroids: int = CENTROIDS, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(the index, its codebook). The codebook is fitted on the ``fit_rows`` rows with the smallest hash of their id; every row is encoded.

    The index is written once, in blocks: ids, labels, vectors, codes and residual norms of up to ``BLOCK`` rows as bytes.
    """
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("i"), "i").limit(fit_rows).select("v").toArrow()["v"].combine_chunks()  # bounded
    whole, exact = _weights(sample, scale)
    fit = whole[[e is None and np.abs(r).max(initial=0) <= _limit(whole.shape[1]) for e, r in zip(exact, whole, strict=True)]] if len(whole) else np.zeros((0, 1))
    book = codebook(fit if len(fit) else np.zeros((1, max(1, whole.shape[1]))), stretch, centroids)
    sent = spark.sparkContext.broadcast(book)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x, exact = _weights(part.column(2), scale)
                large = np.array([e is not None for e in exact], dtype=bool) | (np.abs(x).max(axis=1, initial=0) > _limit(x.shape[1]))
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                few = ~large
                codes, norms = _encode(x[few], sent.value)
                big = [{"i": int(ids[j]), "y": int(labels[j]), "x": [str(int(w)) for w in (x[j] if exact[j] is None else exact[j])]} for j in np.flatnonzero(large)]
                yield pa.RecordBatch.from_pylist([{
                    "n": int(few.sum()), "i": ids[few].tobytes(), "y": labels[few].tobytes(), "x": x[few].astype(np.int32).tobytes(), "codes": codes.tobytes(), "norms": norms.tobytes(),
                    "big": big}], KIND)

    return settle(rows.select("i", "y", "v").mapInArrow(encode, BLOCKS)), book


BLOCKS = "n long, i binary, y binary, x binary, codes binary, norms binary, big array<struct<i: bigint, y: bigint, x: array<string>>>"
KIND = pa.schema([("n", pa.int64()), *((c, pa.binary()) for c in ("i", "y", "x")), ("codes", pa.binary()), ("norms", pa.binary()),
                  ("big", pa.list_(pa.struct([("i", pa.int64()), ("y", pa.int64()), ("x", pa.list_(pa.string()))])))])


class Windows:
    """The best ``k`` rows of each question so far.

    A question is an anchor, whether its own label is asked for or any other, and the lowest and the highest score allowed (None: no bound).
    """

    def __init__(self, anchors: dict, questions: list[tuple[int, int | None, int | None, int | None]], same: bool, k: int, book: np.ndarray) -> None:
        self.anchors, self.questions, self.same, self.k, self.book = anchors, questions, same, k, book
        self.best: list[list[tuple[int, int]]] = [[] for _ in questions]  # (-score, id), sorted
        self.by_anchor: dict[int, list[int]] = {}
        for q, (a, *_) in enumerate(questions):
            self.by_anchor.setdefault(a, []).append(q)
        x = anchors["x"]
        parts, _, stretch = book.shape
        wide = np.pad(x, ((0, 0), (0, max(0, parts * stretch - x.shape[1]))))
        self.wide = wide
        self.norms = np.sqrt(np.stack([(wide[:, s * stretch : (s + 1) * stretch] ** 2).sum(1) for s in range(parts)] + [(wide[:, parts * stretch :] ** 2).sum(1)], axis=1))

    def add(self, block: dict) -> None:
        n, big = block["n"], block["big"]
        ids, labels = np.frombuffer(block["i"], np.int64), np.frombuffer(block["y"], np.int64)
        x = np.frombuffer(block["x"], np.int32).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))
        fast = [a for a in self.by_anchor if self.anchors["big"][a] is None]
        if n:
            codes, norms = np.frombuffer(block["codes"], np.uint16).reshape(n, -1), np.frombuffer(block["norms"]).reshape(n, -1)
            for t in range(0, len(fast), TILE):
                self._tile(np.array(fast[t : t + TILE]), ids, labels, x, codes, norms)
        slow = [a for a in self.by_anchor if self.anchors["big"][a] is not None]
        whole = [(int(i), int(y), [int(w) for w in v]) for i, y, v in zip(ids, labels, x, strict=True)] if slow else []
        large = [(r["i"], r["y"], [int(w) for w in r["x"]]) for r in big]
        for a in fast if large else []:
            self._exact(a, [int(w) for w in self.anchors["x"][a]], large)
        for a in slow:
            self._exact(a, self.anchors["big"][a], whole + large)

    def _tile(self, tile: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> None:
        score = np.zeros((len(tile), len(ids)))
        stretch = self.book.shape[2]
        for s, centroids in enumerate(self.book):
            table = self.wide[tile, s * stretch : (s + 1) * stretch] @ centroids.T  # the anchors' scores of every centroid
            score += table[:, codes[:, s]]
        bound = (self.norms[tile] @ norms.T) * (1 + 1e-9) + 1e-3
        wanted = (labels[None, :] == self.anchors["y"][tile][:, None]) == self.same
        wanted &= ids[None, :] != self.anchors["i"][tile][:, None]
        rows, cols, asked = [], [], []
        for r, a in enumerate(tile.tolist()):
            low, high = score[r] - bound[r], score[r] + bound[r]
            for q in self.by_anchor[a]:
                _, _, least, most = self.questions[q]
                open_ = wanted[r] if most is None else wanted[r] & (low <= most)
                if least is not None:
                    open_ = open_ & (high >= least)
                if len(self.best[q]) == self.k:
                    open_ = open_ & (high >= -self.best[q][-1][0])
                at = np.flatnonzero(open_)
                if len(at) > self.k:  # rows sure to be allowed set a floor
                    sure = low[at][(high[at] <= (np.inf if most is None else most)) & (low[at] >= (-np.inf if least is None else least))]
                    if len(sure) >= self.k:
                        at = at[high[at] >= np.partition(sure, len(sure) - self.k)[len(sure) - self.k]]
                rows.append(np.full(len(at), a))
                cols.append(at)
                asked.append(np.full(len(at), q))
        rows, cols, asked = (np.concatenate(z) if z else np.zeros(0, int) for z in (rows, cols, asked))
        width = min(x.shape[1], self.anchors["x"].shape[1])
        for b in range(0, len(rows), PAIRS):
            r, c, q = rows[b : b + PAIRS], cols[b : b + PAIRS], asked[b : b + PAIRS]
            got = np.einsum("ij,ij->i", self.anchors["x"][r, :width], x[c, :width]).astype(np.int64)  # whole numbers below 2^53: exact
            order = np.lexsort((ids[c], -got, q))
            q, got, own = q[order], got[order], ids[c][order]
            for one in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1) if len(q) else []:
                self._take(int(q[one[0]]), zip(got[one].tolist(), own[one].tolist(), strict=True))

    def _take(self, q: int, found: Iterator[tuple[int, int]]) -> None:
        """``found``: (score, id), best first."""
        _, _, least, most = self.questions[q]
        allowed = []
        for s, i in found:
            if least is not None and s < least or len(allowed) == self.k:
                break
            if most is None or s <= most:
                allowed.append((-s, i))
        if allowed:
            self.best[q] = sorted(self.best[q] + allowed)[: self.k]

    def _exact(self, a: int, own: list[int], rows: list[tuple[int, int, list[int]]]) -> None:
        """Python's integers, for components beyond ``_limit``."""
        found = sorted((-sum(p * w for p, w in zip(own, v, strict=False)), i) for i, y, v in rows if i != self.anchors["i"][a] and (y == self.anchors["y"][a]) == self.same)
        for q in self.by_anchor[a]:
            self._take(q, ((-s, i) for s, i in found))

    def rows(self, ids: list[int | None]) -> pa.RecordBatch:
        out = [(int(self.anchors["i"][a]), ids[q], None if most is None else str(most), i, str(-s)) for q, (a, _, _, most) in enumerate(self.questions) for s, i in self.best[q]]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
        names = [c.split()[0] for c in FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=names)


def digits_order(score: str) -> list[Column]:
    """Orders whole numbers of any length, given as text, from the highest: by sign, length and digits."""
    sign = F.when(F.col(score).startswith("-"), -1).otherwise(1)
    digits = F.when(sign > 0, F.col(score)).otherwise(F.translate(score, "0123456789", "9876543210"))
    return [sign.desc(), (sign * F.length(score)).desc(), digits.desc()]


def _long(score: str) -> Column:
    return F.coalesce(F.expr(f"try_cast({score} AS bigint)"), F.when(F.col(score).startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1)))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", group_bytes: int = GROUP_BYTES, **index: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(``scale`` * x); a score is the integer inner product with an
    anchor, a row for which ``is_anchor`` (over ``i``) holds. Positives: the first ``positives`` other rows of the
    anchor's label, higher scores first, ties by smaller id. Negatives: for each, the first
    ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive.
    Rows with a null id, label, vector or component, or a component that isn't finite, take no
    part; of rows of one id one does, that with the smallest vector, then label. Components of any size count exactly; a
    score beyond a long is given as the nearest. Vectors of unequal length meet on their common
    terms. Empty tables give an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    own = usable(rows, scale, id_col, vector_col, label_col)
    blocks, book = stored(_spread(own), scale, **index)
    asked = settle(own.where(is_anchor))
    n, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    groups = max(1, -(-n * 8 * max(1, width) // group_bytes))
    at = f"{scratch(spark)}/{uuid.uuid4().hex}"

    def search(g: int, questions: list, ids: list, same: bool, k: int, anchors: dict, to: str) -> DataFrame:
        sent = spark.sparkContext.broadcast((anchors, questions, ids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Windows(*sent.value[:2], same, k, sent_book.value)
            for batch in batches:
                for block in batch.to_pylist():
                    found.add(block)
            yield found.rows(sent.value[2])

        blocks.mapInArrow(run, FOUND).write.parquet(f"{at}/{to}/g={g}")
        sent.unpersist()
        return spark.read.schema(FOUND).parquet(f"{at}/{to}/g={g}")

    sent_book = spark.sparkContext.broadcast(book)
    first = Window.partitionBy("anchor_id").orderBy(*digits_order("score"), "vec_id")
    for g in range(groups):
        part = (asked if groups == 1 else asked.where(F.pmod(F.xxhash64("i"), F.lit(groups)) == g)).orderBy("i").toArrow()  # near ``group_bytes``
        x, exact = _weights(part["v"].combine_chunks(), scale)
        big = [e if e is not None else ([int(w) for w in r] if np.abs(r).max(initial=0) > _limit(x.shape[1]) else None) for e, r in zip(exact, x, strict=True)]
        x[[b is not None for b in big]] = 0
        anchors = {"i": part["i"].to_numpy(), "y": part["y"].to_numpy(), "x": x, "big": big}
        got = search(g, [(a, None, None, None) for a in range(part.num_rows)], [None] * part.num_rows, True, positives, anchors, "positives")
        best = got.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives).select("anchor_id", "vec_id", "score").toArrow().to_pylist()  # ``positives`` rows an anchor of the group
        place = {int(i): a for a, i in enumerate(anchors["i"])}
        # Negatives lie between ceil(low * p / 100) and floor(high * p / 100); below 0 there is no such number.
        questions = [(place[r["anchor_id"]], r["vec_id"], -(-low * p // 100), high * p // 100) for r in best if (p := int(r["score"])) >= 0]
        scores = {(r["anchor_id"], r["vec_id"]): r["score"] for r in best}
        search(g, questions, [q[1] for q in questions], False, negatives, anchors, "negatives")
        known = pa.table({"anchor_id": pa.array([k[0] for k in scores], pa.int64()), "positive_id": pa.array([k[1] for k in scores], pa.int64()), "positive": pa.array(list(scores.values()), pa.string())})
        spark.createDataFrame(known).write.parquet(f"{at}/known/g={g}")
    found = spark.read.schema(FOUND).parquet(f"{at}/negatives").withColumnRenamed("vec_id", "negative_id").drop("cap", "g")
    known = spark.read.schema("anchor_id long, positive_id long, positive string").parquet(f"{at}/known").drop("g")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(*digits_order("score"), "negative_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).join(known, ["anchor_id", "positive_id"])
            .select("anchor_id", "positive_id", "rank", "negative_id", _long("positive").alias("positive_score"), _long("score").alias("negative_score")))


#: The query's rows as DuckDB SQL.
ORACLE = """
WITH m AS (
  SELECT vec_id, min({'e': embedding, 'y': CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END}) AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
v AS (SELECT vec_id, list_transform(r.e, lambda x: floor(256 * x::DOUBLE)) AS w, r.y AS y FROM m),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, list_inner_product(a.w, c.w)::BIGINT AS score, a.y = c.y AS same
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score)
SELECT * FROM n WHERE rank <= 3"""
