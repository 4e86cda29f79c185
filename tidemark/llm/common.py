"""What the operators of this subpackage share: reading, shared-storage tables, folds."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python's white space in ``bytes.split``: what separates words everywhere here.
SPACES = r"\x20\x09-\x0D"
#: Runs of ornaments that junk pages append to words ("word!!", "word$$$").
ORNAMENT = r"[!#$%&*]{2,}"
#: Rows of one key from which the key does not go through a shuffle (see ``meet``).
HOT = 50_000
#: Splits and written tables below these sizes are put together.
SPLIT_BYTES, FILE_ROWS = 16 * 2**20, 100_000
#: Bytes of text of each class that a learner sees at most.
TRAIN_BYTES = 32 * 2**20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (one process) gets a folder of its own; on a cluster
    that is an error, for a folder of one machine is not seen by the others.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The folder of this application's written tables."""
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Removes all tables that this application has written; results not yet stored elsewhere are gone with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A scanned table over all cores where it has fewer splits than there are (one row group is one split); larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def gathered(df: DataFrame) -> DataFrame:
    """``df`` with fewer partitions if its scan has very small ones: each task that writes makes a file.

    Splits of ``SPLIT_BYTES`` and more, by Catalyst's estimate of the size, stay as they are.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, min(size // SPLIT_BYTES, 2**30)))


def settle(df: DataFrame, at_most: int | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts lineage, fixes
    generated row ids, and survives the loss of any executor.

    A table of known to be ``at_most`` so many (narrow) rows is written in few files.
    """
    spark = df.sparkSession
    at = f"{scratch(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    if at_most is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, min(at_most // FILE_ROWS, 2**30)))
    df.write.parquet(at)
    return spark.read.schema(schema).parquet(at)


def held_out(doc_id: Column) -> Column:
    """True for the fold that no learner sees: crc32(doc_id as text) mod 5 = 0; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def by_text(function: Callable[[Iterator[pa.Array]], Iterator[pa.Array]], kind: str) -> Callable[[Column], Column]:
    """A column function over texts in Arrow batches: the texts alone go to Python, one value of ``kind`` for each comes back."""
    return F.arrow_udf(function, kind)


def meet(rows: DataFrame, facts: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` left-joined to ``facts``, which has one row of each key and in ``n`` how many of ``rows`` have it.

    Keys of more than ``HOT`` rows are sent to the rows where they are, of which there are
    at most rows / ``HOT``; all others meet by a shuffle in which no key is hot. Null keys
    meet nothing. ``n`` is dropped.
    """
    hot = facts.where(F.col(n) > HOT).drop(n)
    if not hot.limit(1).count():
        return rows.join(facts.drop(n), key, "left")
    near = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    names = [c for c in facts.columns if c not in (key, n)]
    cold = near.where(F.col("_hot").isNull()).drop("_hot", *names)
    return near.where("_hot").drop("_hot").unionByName(cold.join(facts.where(F.col(n) <= HOT).drop(n), key, "left"))


def labelled(docs: DataFrame, labels: DataFrame, target: str, rows: int, max_bytes: int = TRAIN_BYTES) -> list[tuple[str, int]]:
    """(text, label) of a bounded training sample: of each class the ``rows`` rows with
    the smallest hash of the id, held-out rows and null labels left out. Sorted by label and hash.
    Rows whose texts would pass ``max_bytes`` bytes of a class together are left out."""
    own = labels.select("doc_id", F.col(target).cast("int").alias("_y")).where(
        F.col("_y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("_y").alias("_y"))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t")).withColumn("_b", F.octet_length("_t"))
    order = [F.xxhash64(F.col("doc_id")), F.col("doc_id")]
    of = lambda y: own.where(F.col("_y") == y).orderBy(*order).limit(rows)
    texts = texts.join(F.broadcast(of(0).unionByName(of(1))), "doc_id")  # at most 2 * ``rows`` ids: bounded
    ids, room = [], {0: max_bytes, 1: max_bytes}
    for r in texts.groupBy("_y", "doc_id").agg(F.sum("_b").alias("n")).orderBy("_y", *order).collect():
        if r["n"] <= room[r["_y"]]:
            room[r["_y"]] -= r["n"]
            ids.append(r["doc_id"])
    got = texts.where(F.col("doc_id").isin(ids)) if ids else texts.limit(0)
    out, n = [], Counter()
    for r in got.orderBy("_y", *order, "_t").collect():
        n[r["_y"]] += 1
        if n[r["_y"]] <= rows:
            out.append((r["_t"], r["_y"]))
    return out
