"""Exact top-k search by exhaustive term-at-a-time accumulation.

A candidate block is turned into postings (term -> candidates, weights). Each sparse
query row scatters ``query weight * posting weight`` term after term into a dense
array of scores; a partition selection keeps k of each block, and the few survivors
of all blocks are merged by query. Queries are sent to the candidates in groups of at
most ``GROUP_BYTES``, so what is broadcast has a fixed bound at any input size; each
group is one pass over the candidates, and its survivors are written, so that the plan
does not grow with the number of groups.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, settle

#: Bytes of query vectors (8 a component) that are sent at once.
GROUP_BYTES = 64 * 2**20
TILE_Q, TILE_C = 64, 2048
#: Repeated ids (8 bytes each) that are broadcast at most; more meet the candidates by a shuffle.
BROADCAST_IDS = 500_000
NONE = np.iinfo(np.int64).min


def _weights(vectors: pa.Array, scale: float) -> tuple[np.ndarray, list[list[int]]]:
    """(matrix of the floors of scale * x, as far as doubles hold them, else zeros; the other rows as Python integers, or None).

    Shorter vectors are padded by 0.
    """
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    large = np.flatnonzero((~(np.abs(out) < 2.0**53)).any(axis=1))
    exact: list = [None] * len(sizes)
    for i in large:
        exact[i] = [math.floor(Fraction(scale) * Fraction(x)) for x in vectors[int(i)].as_py()]
        out[i] = 0
    return out, exact


def _small(matrix: np.ndarray, exact: list) -> np.ndarray:
    """Rows whose products with each other all fit into a sort key of 63 bits."""
    limit = math.isqrt(2**50 // max(1, matrix.shape[1]))
    return (np.abs(matrix).max(axis=1, initial=0) <= limit) & np.array([e is None for e in exact], dtype=bool)


def _postings(c: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [(t, idx, c[idx, t]) for t in range(c.shape[1]) if len(idx := np.flatnonzero(c[:, t]))]


def _accumulate(part: np.ndarray, postings: list, n: int) -> np.ndarray:
    """Scores of the query rows ``part`` against ``n`` candidates, term after term."""
    acc = np.zeros((len(part), n), dtype=part.dtype)
    for t, idx, w in postings:
        if t >= part.shape[1]:
            break
        rows = np.flatnonzero(part[:, t])  # only queries that hold the term
        if len(idx) == n and len(rows) == len(part):
            acc += part[:, t, None] * w[None, :]
        elif len(rows):
            acc[np.ix_(rows, idx)] += part[rows, t][:, None] * w[None, :]
    return acc


class Best:
    """The k best candidates of every query so far: scores and ids, best first; ties to the smaller id."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, exact: list, k: int) -> None:
        self.q_ids, self.q, self.exact, self.k = q_ids, q, exact, k
        self.fast = np.flatnonzero(_small(q, exact))
        self.slow = np.flatnonzero(~_small(q, exact))
        self.score = np.full((len(q_ids), k), NONE)
        self.id = np.zeros((len(q_ids), k), dtype=np.int64)
        self.beyond: dict[int, list[tuple[int, int]]] = {}  # query row -> (score, id) where 63 bits may not hold a score

    def add(self, ids: np.ndarray, c: np.ndarray, exact: list) -> None:
        """Takes in one candidate block: ids, weights, and the rows that only integers hold."""
        order = np.argsort(ids, kind="stable")
        ids, c, exact = ids[order], c[order], [exact[i] for i in order]
        small = _small(c, exact)
        few, rest = np.flatnonzero(small), np.flatnonzero(~small)
        if len(few):
            self._fast(ids[few], c[few])
        if len(few) and len(self.slow):
            self._slow(self.slow, ids[few], c[few], [None] * len(few))
        if len(rest):
            self._slow(np.arange(len(self.q_ids)), ids[rest], c[rest], [exact[i] for i in rest])

    def _fast(self, ids: np.ndarray, c: np.ndarray) -> None:
        q, n, k = self.q[self.fast], len(ids), self.k
        bound = float(np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, min(q.shape[1], c.shape[1])))
        kind = np.float32 if bound < 2**24 else np.float64
        postings, q = _postings(c.astype(kind)), q.astype(kind)
        place = (n - 1 - np.arange(n)).astype(np.int64)  # among equal scores the first, that is the smallest id, is highest
        for a in range(0, len(q), TILE_Q):
            rows = self.fast[a : a + TILE_Q]
            key = _accumulate(q[a : a + TILE_Q], postings, n).astype(np.int64) * TILE_C + place[None, :]
            if self.score[rows, -1].min() > NONE:  # beyond the first blocks, few candidates come in at all
                hopeful = (key // TILE_C >= self.score[rows, -1][:, None]).any(axis=1)
                rows, key = rows[hopeful], key[hopeful]
                if not len(rows):
                    continue
            key[ids[None, :] == self.q_ids[rows][:, None]] = NONE
            if n > k:
                key = np.partition(key, n - k, axis=1)[:, n - k :]
            there = key > NONE
            score, found = np.where(there, key // TILE_C, NONE), ids[np.where(there, n - 1 - key % TILE_C, 0)]
            score, found = np.hstack([self.score[rows], score]), np.hstack([self.id[rows], found])
            best = np.lexsort((found, -np.maximum(score, NONE + 1)), axis=1)[:, :k]
            self.score[rows], self.id[rows] = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)

    def _slow(self, rows: np.ndarray, ids: np.ndarray, c: np.ndarray, exact: list) -> None:
        """Python integers, for weights whose scores may pass 50 bits."""
        whole = lambda m, e, i: e[i] if e[i] is not None else [int(x) for x in m[i]]
        cs = [whole(c, exact, j) for j in range(len(ids))]
        for r in rows.tolist():
            own = whole(self.q, self.exact, r)
            found = [(sum(a * b for a, b in zip(own, w, strict=False)), int(i)) for i, w in zip(ids, cs, strict=True) if i != self.q_ids[r]]
            self.beyond[r] = sorted([*self.beyond.get(r, []), *found], key=lambda x: (-x[0], x[1]))[: self.k]

    def rows(self) -> pa.RecordBatch:
        """query_id, vec_id, score as a decimal text; all that is kept."""
        at = np.nonzero(self.score > NONE)
        q, i, s = self.q_ids[at[0]].tolist(), self.id[at].tolist(), self.score[at].astype(str).tolist()
        for r, found in self.beyond.items():
            q += [int(self.q_ids[r])] * len(found)
            i += [j for _, j in found]
            s += [str(x) for x, _ in found]
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.string())], names=["query_id", "vec_id", "score"])


def _unique(rows: DataFrame) -> DataFrame:
    """One row of each id ``i``, that with the smallest vector ``v``; only rows of repeated ids are shuffled with their vectors."""
    repeated = rows.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i")  # shuffles ids alone
    n = repeated.limit(BROADCAST_IDS + 1).count()
    if not n:
        return rows
    repeated = settle(repeated)
    sent = F.broadcast(repeated) if n <= BROADCAST_IDS else repeated
    return rows.join(sent, "i", "left_anti").unionByName(rows.join(sent, "i", "left_semi").groupBy("i").agg(F.min("v").alias("v")))


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where the scan has fewer splits than there are; a table of more splits stays where it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: float = 256.0,
               id_col: str = "vec_id", vector_col: str = "embedding", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest integer inner products of each query.

    Every candidate but those with the query's own id takes part; ties go to the
    smaller id. Rows with a null id, a null vector, or a null or non-finite component take
    no part on either side; components of any size do, by exact integers where doubles do
    not hold them. Ranks follow exact scores; a score that a long does not hold is given
    as the nearest long. Repeated ids: one row of the id counts, that with the smallest
    vector. Vectors of unequal length meet on their common terms. Empty tables give an
    empty result. Other columns are ignored.
    """
    spark = candidates.sparkSession

    def fit(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
        whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return df.where(F.col("i").isNotNull() & F.col("v").isNotNull() & whole)

    q, c = fit(queries).groupBy("i").agg(F.min("v").alias("v")), _spread(_unique(fit(candidates)))
    size = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    groups = max(1, -(-size[0] * 8 * max(1, size[1]) // group_bytes))
    at = f"{scratch(spark)}/{uuid.uuid4().hex}"
    for g in range(groups):
        own = (q if groups == 1 else q.where(F.pmod(F.xxhash64("i"), F.lit(groups)) == g)).toArrow()  # one group: near ``group_bytes``
        sent = spark.sparkContext.broadcast((own["i"].to_numpy(), *_weights(own["v"].combine_chunks(), scale)))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = Best(*sent.value, k)
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for a in range(0, len(ids), TILE_C):
                    best.add(ids[a : a + TILE_C], *_weights(batch.column(1).slice(a, TILE_C), scale))
            yield best.rows()

        c.select("i", "v").mapInArrow(score, "query_id long, vec_id long, score string").write.parquet(f"{at}/g={g}")
        sent.unpersist()
    found = spark.read.schema("query_id long, vec_id long, score string").parquet(at)
    # Numbers of any length are ranked by sign, length and digits.
    sign = F.when(F.col("score").startswith("-"), -1).otherwise(1)
    digits = F.when(sign > 0, F.col("score")).otherwise(F.translate("score", "0123456789", "9876543210"))
    best = Window.partitionBy("query_id").orderBy(sign.desc(), (sign * F.length("score")).desc(), digits.desc(), "vec_id")
    kept = F.coalesce(F.expr("try_cast(score AS bigint)"), F.when(sign > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63))))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", kept.alias("score")))
