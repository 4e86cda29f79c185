"""A stored inverted index of character n-grams, searched by block maxima.

Documents are cut once, when they are appended. A posting row holds documents of one
term within one range of ids, and the largest share that the term has in one of them; a range
of much text has several rows of a term. Sums of those bound the scores of a whole range, so a search reads the ranges that can still reach
the k-th best score, and no others. Scores equal those of an exhaustive search.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.checkpoints import settle
from ..sources.snapshots import SnapshotStore

#: Ids of a range, classes of terms, decimal places of a score.
RANGE, BUCKETS, DIGITS = 4096, 64, 9
#: Texts normalised at once, n-grams of a piece, its posting rows sent at once, n-grams of a task, rows that are sent to all tasks.
SLICE, PIECE, ROWS, TASK, BROADCAST = 256, 8_000_000, 20_000, 20_000_000, 500_000


@F.arrow_udf(StringType())
def normal(texts: pa.Array) -> pa.Array:
    """Compatibility forms composed, case folded, single spaces; null is empty. A few texts at a time are Python's."""
    cut = [pa.array([" ".join(unicodedata.normalize("NFKC", t or "").casefold().split()) for t in texts.slice(at, SLICE).to_pylist()], pa.string()) for at in range(0, len(texts), SLICE)]
    return pa.concat_arrays(cut) if cut else pa.array([], pa.string())


def total(text: Column, low: int, high: int) -> Column:
    """How many character n-grams a normal text has."""
    return sum((F.greatest(F.length(text) - n + 1, F.lit(0)) for n in range(low, high + 1)), F.lit(0)).cast("long")


def counted(text: str, low: int, high: int) -> Counter:
    """The character n-grams of a normal text and how often each comes."""
    found, longer = Counter(), list(text)
    for n in range(1, high + 1):
        if n >= low:
            found.update(longer)
        longer = list(map(add, longer, text[n:]))
    return found


def grams(texts: DataFrame, low: int, high: int) -> DataFrame:
    """id, term, tf of texts (id, text)."""
    normed, schema = texts.select("id", normal(F.col("text")).alias("text")), f"id {texts.schema['id'].dataType.simpleString()}, term string, tf long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                found = counted(t.as_py(), low, high)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(found), batch.schema.field(0).type), pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["id", "term", "tf"])

    return normed.mapInArrow(rows, schema)


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as bytes of seven bits, low bits first, and how many bytes each has."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[(ends - size)[own] + k] = (values[own] >> 7 * k & 127) | np.where(size[own] > k + 1, 128, 0)
    return out, size


def integers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of ``varints`` and where each ends."""
    ends = np.flatnonzero(raw < 128) + 1
    starts = np.append(0, ends[:-1])
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=0))):
        own = np.flatnonzero(ends - starts > k)
        out[own] |= (raw[starts[own] + k] & 127).astype(np.int64) << 7 * k
    return out, ends


def postings_of(column: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """at, tf of the documents of all posting rows, ``n`` of each; ``column``: their ``docs``."""
    limits = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values, ends = integers(np.frombuffer(column.buffers()[2] or b"", np.uint8)[limits[0] : limits[-1]])
    held = np.diff(np.searchsorted(ends, limits - limits[0], side="right"))  # integers of each row: gaps, then frequencies over 1
    begin = np.cumsum(held) - held
    gaps = np.arange(len(values)) - np.repeat(begin, held) < np.repeat(n, held)
    step, tf = values[gaps] >> 1, np.ones(int(n.sum()), np.int64)
    tf[values[gaps] & 1 == 1] = values[~gaps]
    run = np.cumsum(step)
    first = np.cumsum(n) - n
    return run - np.repeat(run[first] - step[first], n), tf


def bucket_of(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    """The class of terms by their first two characters (the second 0 in terms of one), so that sorted terms of a class stay alike."""
    return ((first.astype(np.int64) * 31 + second) % buckets).astype(np.int32)


def strings(cells: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    size = 1 + (cells >= 0x80) + (cells >= 0x800) + (cells >= 0x10000)
    text = np.frombuffer(cells.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    ends = np.append(0, np.cumsum(size.sum(axis=1))).astype(np.int32)
    return pa.StringArray.from_buffers(len(cells), pa.py_buffer(ends), pa.py_buffer(text))


def piece_rows(texts: list[str], ids: list[int], low: int, high: int, buckets: int) -> Iterator[tuple]:
    """term, most, n, docs, bucket of each length of n-gram, as arrays: what the texts of a piece, in order of their ids, have.

    An n-gram is a number: its characters as digits, of the alphabet that the piece has. Where those grow too long, the
    shorter n-grams are numbered anew. Numbers are sorted with the document, so that no n-gram is an object.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    totals = sum(np.maximum(size - n + 1, 0) for n in range(low, high + 1)).astype(float)
    doc, ids = np.repeat(np.arange(len(texts), dtype=np.int32), size), np.array(ids, np.int64)
    place = np.zeros(0x110000, np.int32)
    place[points] = 1
    alphabet = np.flatnonzero(place)
    place[alphabet] = np.arange(len(alphabet))
    sign = place[points]
    digits, many, numbered = max(1, len(alphabet)), len(texts), {}
    code, top = sign.astype(np.int64), digits
    for n in range(1, high + 1):
        if n > 1:
            if top * digits * many >= 1 << 62:
                numbered[n - 1], code = np.unique(code, return_inverse=True)
                top = len(numbered[n - 1])
            code, top = code[: max(0, len(sign) - n + 1)] * digits + sign[n - 1 :], top * digits
        if n < low:
            continue
        key = (code * many + doc[: len(code)])[doc[: len(code)] == doc[n - 1 :]]
        if not len(key):
            continue
        key.sort()
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        tf, key = np.diff(starts, append=len(key)), key[starts]
        term = key // many
        of = key - term * many
        rows = np.flatnonzero(np.diff(term, prepend=-1))
        left, cells = term[rows], np.empty((len(rows), n), np.int64)
        for k in range(n, 0, -1):
            left = numbered[k][left] if k in numbered and k < n else left
            cells[:, k - 1] = alphabet[left % digits]
            left = left // digits
        bucket = bucket_of(cells[:, 0], cells[:, 1] if n > 1 else 0, buckets)
        order = np.argsort(bucket, kind="stable")
        count = np.diff(rows, append=len(key))
        most = np.nextafter(np.maximum.reduceat(tf / totals[of], rows).astype(np.float32), np.float32(2))
        most = ((most.view(np.uint32) + 0xFFFF) & 0xFFFF0000).view(np.float32)  # a bound may be larger: half of its bits are left out
        # Documents as gaps, doubled, odd where the frequency is over 1; those frequencies follow the gaps of the row.
        at = ids[of]
        gap = np.diff(at, prepend=0)
        gap[rows] = at[rows]
        often = tf > 1
        row = np.repeat(np.arange(len(rows)), count)
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows))
        values, owner = np.concatenate([gap * 2 + often, tf[often]]), np.concatenate([rank[row], rank[row[often]]])
        values = values[np.argsort(owner, kind="stable")]
        raw, size_of = varints(values)
        held = np.bincount(owner, minlength=len(rows))
        ends = np.append(0, np.cumsum(np.add.reduceat(size_of, np.cumsum(held) - held))).astype(np.int32)
        docs = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        yield strings(cells[order]), most[order], count[order], docs, bucket[order]


def posting_rows(docs: DataFrame, low: int, high: int, buckets: int = BUCKETS) -> DataFrame:
    """range, term, most, n, docs, bucket of normal texts (at: place in the range, range, text) that stand together by range: a row for each term of a piece of a range.

    A piece has PIECE n-grams, or one document more, so a task holds no range whole and a row stays small however common its term.
    """
    def piece(key: int, ids: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
        for term, most, n, found, bucket in piece_rows(texts, ids, low, high, buckets):
            for i in range(0, len(term), ROWS):
                m = min(ROWS, len(term) - i)
                yield pa.RecordBatch.from_arrays([pa.array([key] * m, pa.int64()), term.slice(i, m), pa.array(most[i : i + m]), pa.array(n[i : i + m], pa.int64()), found.slice(i, m), pa.array(bucket[i : i + m])], names=["range", "term", "most", "n", "docs", "bucket"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, texts, held = None, [], [], 0
        for batch in batches:
            for i, own, t in zip(*batch.columns, strict=True):
                i, own, t = i.as_py(), own.as_py(), t.as_py()
                if texts and (own != key or held >= PIECE):
                    yield from piece(key, ids, texts)
                    ids, texts, held = [], [], 0
                key = own
                if len(t) >= low:
                    ids.append(i)
                    texts.append(t)
                    held += sum(max(0, len(t) - n + 1) for n in range(low, high + 1))
        if texts:
            yield from piece(key, ids, texts)

    return docs.select("at", "range", "text").mapInArrow(rows, "range long, term string, most float, n long, docs binary, bucket int")


def weighed(rows: DataFrame, ids: int) -> DataFrame:
    """query_id, id, s: of posting rows with a weight (query_id, w, range, n, docs) what each document gets, summed within a batch."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, len(batch), 1000)):
                n = part.column(3).to_numpy()
                at, tf = postings_of(part.column(4), n)
                query, w, span = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), n) for c in (0, 1, 2))
                queries, q = np.unique(query, return_inverse=True)
                spans, r = np.unique(span, return_inverse=True)
                keys, of = np.unique((q * len(spans) + r) * ids + at, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(queries[keys // ids // len(spans)], batch.schema.field(0).type), pa.array(spans[keys // ids % len(spans)] * ids + keys % ids), pa.array(np.bincount(of, w * tf))], names=["query_id", "id", "s"])

    return rows.mapInArrow(sums, f"query_id {rows.schema['query_id'].dataType.simpleString()}, id long, s double")


def near(df: DataFrame) -> DataFrame:
    """A stored table, sent to all tasks if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


class LexicalIndex:
    """An index at ``path``: tables ``documents`` (id, total and what else the documents have) and ``postings``, under one manifest."""

    def __init__(self, spark: SparkSession, path: str, low: int = 2, high: int = 5, ids: int = RANGE, buckets: int = BUCKETS) -> None:
        if not 1 <= low <= high <= 8:
            raise ValueError("invalid bounds of n-grams")
        self.spark, self.low, self.high, self.ids, self.buckets = spark, low, high, ids, buckets
        self.store = SnapshotStore(spark, path)

    def _bucket(self, term: str) -> Column:
        point = lambda at: F.coalesce(F.ascii(F.substring(term, at, 1)), F.lit(0)).cast("long")
        return ((point(1) * 31 + point(2)) % self.buckets).cast("int")

    def append(self, docs: DataFrame) -> int:
        """Adds documents (id, text, further columns to filter by) and returns the version.

        Ids must be new and not null. Null, empty and short texts count as documents and are never found.
        """
        base = self.store.head()
        keys = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        if keys.where("id IS NULL OR n > 1").limit(1).count():
            raise ValueError("ids must be unique and not null")
        if base and docs.join(self.store.read("documents", base), "id", "left_semi").limit(1).count():
            raise ValueError("documents are stored already")
        cut = docs.withColumn("text", normal(F.col("text")))
        facts = settle(cut.withColumn("total", total(F.col("text"), self.low, self.high)).drop("text"))
        n = facts.agg(F.sum("total")).first()[0] or 0
        ranged = cut.select(F.pmod("id", F.lit(self.ids)).cast("int").alias("at"), F.expr(f"(id - pmod(id, {self.ids})) div {self.ids}").alias("range"), "text")
        # The texts travel, not their n-grams: a range's terms meet within one task, piece by piece, and are written as they come.
        together = ranged.repartition(int(n // TASK) + 1, "range").sortWithinPartitions("range", "at")
        return self.store.commit({"documents": facts, "postings": posting_rows(together, self.low, self.high, self.buckets)}, expected=base)

    def documents(self, version: int | None = None) -> DataFrame:
        return self.store.read("documents", version)

    def frequencies(self, version: int | None = None) -> DataFrame:
        """term, df: in how many documents each term stands."""
        return self.store.read("postings", version).groupBy("term").agg(F.sum("n").alias("df"))

    def search(self, queries: DataFrame, k: int = 10, eligible: Column | None = None, version: int | None = None, first: int = 2) -> DataFrame:
        """query_id, rank, id, score: the ``k`` best documents of each query (query_id, text), ties to the smaller id.

        Term frequencies and the number of documents are those of all documents; ``eligible``, over the
        documents' columns, says what may be found. The ``first`` ranges with the highest bounds are scored first; after
        them only ranges whose bound reaches the k-th score so far.
        """
        postings, docs = self.store.read("postings", version), self.documents(version)
        n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
        asked = grams(queries.select(F.col("query_id").alias("id"), "text"), self.low, self.high).select(F.col("id").alias("query_id"), "term", F.col("tf").alias("q_tf")).withColumn("bucket", self._bucket("term"))
        asked = settle(asked)
        classes = [r.bucket for r in asked.select("bucket").distinct().collect()]  # as many as there are classes at most
        postings = postings.where(F.col("bucket").isin(classes))
        wanted = settle(asked.select("term").distinct())
        blocks = settle(postings.select("term", "range", "most", "n").join(near(wanted), "term"))  # what the terms asked for have, without their documents
        df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        terms = settle(asked.join(df, "term").select("query_id", "term", (F.col("q_tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("w")))
        highest = blocks.groupBy("term", "range").agg(F.max("most").alias("most"))  # over the pieces of a range
        bounds = highest.join(near(terms), "term").groupBy("query_id", "range").agg(F.sum(F.col("w") * F.col("most")).alias("bound"))
        bounds = settle(bounds.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))))  # a row for each range
        allowed = (docs.where(eligible) if eligible is not None else docs).select("id", "total")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

        def scored(ranges: DataFrame) -> DataFrame:
            """The k best of each query within its ``ranges``."""
            found = postings.select("term", "range", "n", "docs").join(near(terms), "term").join(near(settle(ranges)), ["query_id", "range"])
            sums = weighed(found.select("query_id", "w", "range", "n", "docs"), self.ids).groupBy("query_id", "id").agg(F.sum("s").alias("s"))
            own = sums.join(allowed, "id").select("query_id", "id", F.round(F.col("s") / F.col("total"), DIGITS).alias("score")).where("score > 0")
            return own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

        start = settle(scored(bounds.where(F.col("place") <= first).select("query_id", "range")))
        reached = start.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        left = bounds.where(F.col("place") > first).join(reached, "query_id", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - 2 * 10.0**-DIGITS)
        both = start.drop("rank").unionByName(scored(left.select("query_id", "range")).drop("rank"))
        return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
