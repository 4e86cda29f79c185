"""Near-duplicate clusters that grow batch by batch, with the postings of all earlier items in a store.

Each item takes the cluster of its best earlier near-duplicate; what was assigned before
never changes. Candidates are the earlier items that share a run of three tokens, rarest runs first,
until there are ``most``; of a larger union the latest count. So an item meets at most ``most`` others
however common its words, which is the feature: a bounded search with the same result in any batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.checkpoints import settle
from ..sources.snapshots import SnapshotStore
from .text import follow, named_cluster, reachable, sketches

#: The documented bound of candidates.
MOST = 256


class ClusterStore:
    """Tables ``items`` (id, text_hash, toks, cluster_id) and ``postings`` (run, id) below ``path``; each batch is one version."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.82, most: int = MOST) -> None:
        if not 0 <= threshold <= 1 or most < 1:
            raise ValueError("threshold must be within 0 and 1, most positive")
        self.threshold, self.most, self.store = threshold, most, SnapshotStore(spark, path)

    def clusters(self, version: int | None = None) -> DataFrame:
        return self.store.read("items", version).select("id", "cluster_id")

    def append(self, items: DataFrame) -> DataFrame:
        """id, cluster_id of a batch: ``items`` with id (larger than all stored ones, in order of availability), text, toks.

        Ids must be unique and not null; a null text is empty. An empty batch changes nothing.
        """
        base = self.store.head()
        new = settle(items.select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("toks", F.array().cast("array<string>")).alias("toks")).withColumn("text_hash", F.sha2("text", 256)))
        first, n, ids = new.agg(F.min("id"), F.count(F.lit(1)), F.count_distinct("id")).first()
        if n != ids:
            raise ValueError("ids must be unique and not null")
        if not n:
            return new.select("id", F.lit("").alias("cluster_id"))
        old = self.store.read("items", base) if base else new.select("id", "text_hash", "toks", F.lit("").alias("cluster_id")).limit(0)
        if base and (last := old.agg(F.max("id")).first()[0]) is not None and first <= last:
            raise ValueError("a batch must follow what is stored")
        runs = settle(new.select("id", F.explode(F.array_distinct(T.shingles(F.col("toks")))).alias("run")).select(F.xxhash64("run").alias("run"), "id").distinct())
        stored = self.store.read("postings", base) if base else runs.limit(0)
        pairs = self._candidates(runs, stored)
        every = old.select("id", "toks").unionByName(new.select("id", "toks"))
        # Sketches first: most pairs share a few runs alone, and their tokens need not travel.
        known = settle(sketches(every))
        for key, name in (("id", "a"), ("earlier", "b")):
            pairs = pairs.join(known.select(F.col("id").alias(key), F.col("sketch").alias(name)), key, "left")
        pairs = settle(pairs.where(reachable("a", "b", self.threshold)).select("id", "earlier"))
        both = pairs.join(new.select("id", F.col("toks").alias("a")), "id").join(every.select(F.col("id").alias("earlier"), F.col("toks").alias("b")), "earlier")
        both = both.withColumn("j", T.jaccard(F.array_distinct("a"), F.array_distinct("b")))
        can = 2.0 * F.least(F.size("a"), F.size("b")) / F.greatest(F.lit(1), F.size("a") + F.size("b"))
        asked = can > F.col("j")
        ordered = T.sequence_ratio(F.when(asked, F.col("a")), F.when(asked, F.col("b")), self.threshold)  # null where Jaccard is as large as it can be
        similar = both.withColumn("similarity", F.greatest("j", ordered)).where(F.col("similarity") >= self.threshold).select("id", "earlier", "similarity")
        # The same text again goes with the first item of that text, whatever is similar.
        texts = old.select("id", "text_hash").unionByName(new.select("id", "text_hash")).groupBy("text_hash").agg(F.min("id").alias("earlier"))
        same = new.select("id", "text_hash").join(texts, "text_hash").where("earlier < id").select("id", "earlier", F.lit(2.0).alias("similarity"))
        edges = settle(similar.unionByName(same))
        best = edges.groupBy("id").agg(F.max("similarity").alias("similarity"))
        edges = edges.join(best, ["id", "similarity"]).join(old.select(F.col("id").alias("earlier"), "cluster_id"), "earlier", "left").select("id", "earlier", "cluster_id")
        found = settle(follow(new.select("id", named_cluster(F.col("text")).alias("cluster_id")), settle(edges)))
        rows = new.join(found, "id").select("id", "text_hash", "toks", "cluster_id")
        self.store.commit({"items": rows, "postings": runs}, expected=base)
        return found

    def _candidates(self, runs: DataFrame, stored: DataFrame) -> DataFrame:
        """id, earlier: for each new item the earlier ones that its runs lead to, ``most`` at most."""
        most = self.most
        placed = settle(runs.withColumn("place", (F.row_number().over(Window.partitionBy("run").orderBy("id")) - 1).cast("long")))  # how many of the batch came before
        asked = runs.select("run").distinct()
        near = settle(stored.join(asked, "run", "left_semi"))
        held = near.groupBy("run").agg(F.count(F.lit(1)).alias("held"))
        length = F.coalesce("held", F.lit(0)) + F.col("place")
        order = Window.partitionBy("id").orderBy("length", "run")
        # A run that leads to enough items alone is the last one looked at, so the common ones are never paired.
        kept = placed.join(held, "run", "left").withColumn("length", length).where("length > 0").withColumn("step", F.row_number().over(order)).withColumn("before", F.max("length").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        kept = settle(kept.where(F.coalesce("before", F.lit(0)) < most).select("run", "id", "place", "step"))
        latest = near.withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("id")))).where(F.col("k") <= most).select("run", F.col("id").alias("earlier"))
        block = F.floor(F.col("place") / most)
        others = placed.select("run", F.col("id").alias("earlier"), F.col("place").alias("other"), F.explode(F.array(block, block + 1)).alias("block"))
        batch = kept.withColumn("block", block).join(others, ["run", "block"]).where((F.col("other") < F.col("place")) & (F.col("other") >= F.col("place") - most))
        led = kept.join(latest, "run").select("id", "earlier", "step").unionByName(batch.select("id", "earlier", "step"))
        first = settle(led.groupBy("id", "earlier").agg(F.min("step").alias("step")))
        added = first.groupBy("id", "step").agg(F.count(F.lit(1)).alias("n"))
        so_far = F.coalesce(F.sum("n").over(Window.partitionBy("id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        looked = added.withColumn("so_far", so_far).where(F.col("so_far") < most).select("id", "step")  # the run that reaches the bound still counts whole
        recent = Window.partitionBy("id").orderBy(F.desc("earlier"))
        return first.join(looked, ["id", "step"]).withColumn("k", F.row_number().over(recent)).where(F.col("k") <= most).select("id", "earlier")
