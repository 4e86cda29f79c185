"""Lineage over event tables: where each event's chain of parents leads, and what a freeze claims that the log does not bear out."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import settle

#: Rows of one key from which the key is sent to the rows where they are.
HOT = 50_000


def lookup(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined to ``facts``, which has one row of each ``key``; keys of very many rows don't meet in one task."""
    counts = settle(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).drop("_n"))  # rows / HOT keys at most
    if not counts.limit(1).count():
        return rows.join(facts, key, "left")
    hot = facts.join(F.broadcast(counts), key, "left_semi")
    own = rows.join(F.broadcast(counts), key, "left_semi").join(F.broadcast(hot), key, "left")
    return own.unionByName(rows.join(F.broadcast(counts), key, "left_anti").join(facts, key, "left"))


def roots(events: DataFrame, key: str, parent: str) -> DataFrame:
    """key, root, depth, status of every event, by pointer jumping: a chain of n events takes about log2(n) rounds.

    root is the last event found on the way up, depth its distance. status: complete (the root
    names no parent), broken (it names one that isn't there) or cyclic (no root: null). Keys must be unique; null keys are left out.
    """
    own = events.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(parent).alias("up"))
    known = own.select(F.col("k").alias("up"), F.lit(True).alias("there"))
    start = lookup(own, known, "up").select("k", "up", F.coalesce("there", F.lit(False)).alias("there"))
    # Roots point nowhere; all others at a parent that is there.
    up, none = F.col("up"), F.lit(None).cast(own.schema["k"].dataType)
    root = F.when(~F.col("there"), F.col("k"))
    status = F.when(~F.col("there"), F.when(up.isNull(), "complete").otherwise("broken"))
    nodes = settle(start.select("k", F.when(F.col("there"), up).alias("at"), F.col("there").cast("long").alias("depth"), root.alias("root"), status.alias("status")))
    done, open_, before = nodes.where("at IS NULL"), nodes.where("at IS NOT NULL"), -1
    while (left := open_.count()) and left != before:  # a round that settles nothing has only cycles left, once pointers span all events
        # What an event points at tells its root, or else where to point next: one join a round.
        ahead = done.unionByName(open_).select(F.col("k").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), "root", "status")
        met = settle(lookup(open_.select("k", "at", "depth"), ahead, "at").select("k", F.when(F.col("root").isNull(), F.col("next")).alias("at"), (F.col("depth") + F.col("more")).alias("depth"), "root", "status"))
        done, open_, before = done.unionByName(met.where("at IS NULL")), met.where("at IS NOT NULL"), left
    cyclic = open_.select("k", none.alias("root"), F.lit(None).cast("long").alias("depth"), F.lit("cyclic").alias("status"))
    return done.select("k", "root", "depth", "status").unionByName(cyclic).withColumnRenamed("k", key)


def freeze_violations(events: DataFrame) -> DataFrame:
    """event_hash, rule: a row for each link of a freeze that the log does not bear out; sound freezes give none.

    ``events``: event_hash, study, seq, kind, actor, proposal, definition, run, result, model, approval (null where the kind has none).
    A freeze must be a human's, name a proposal and a compiled definition of its study, a human's
    approval of that definition, exactly one completed run with its result and model, and that run exactly one start with
    its definition; all of them earlier in its study's log. An event hash stands for one event.
    """
    frozen = events.where("kind = 'frozen'")
    own = settle(frozen.select("event_hash", "study", F.col("seq").alias("_seq"), F.col("actor").alias("_actor"), *(F.col(c).alias(f"_{c}") for c in ("proposal", "definition", "result", "model", "approval"))))
    earlier = F.col("seq") < F.col("_seq")

    def count(kind: str, same: list[str], more: Column | None = None) -> DataFrame:
        """event_hash, seq and run of the freeze's matching earlier events of a kind."""
        there = events.where(F.col("kind") == kind).withColumnRenamed("event_hash", "hash")
        on = earlier if more is None else earlier & more
        return own.join(there, "study").where(on & _all(F.col(c) == F.col(f"_{c}") for c in same))

    completed = settle(count("completed", ["result", "model"]).select("event_hash", F.col("seq").alias("_done"), F.col("run").alias("_run"), "_definition", "study"))
    starts = events.where("kind = 'started'").select("study", "run", "seq", F.col("definition").alias("_begun"))
    started = completed.join(starts, "study").where((F.col("run") == F.col("_run")) & (F.col("seq") < F.col("_done")))
    approvals = count("approved", ["definition"], (F.col("hash") == F.col("_approval")) & (F.col("actor") == "human"))
    # One row for each match, counted together, so no task sorts the freezes once for each kind.
    found = {"proposals": count("proposed", ["proposal"]), "compiles": count("compiled", ["proposal", "definition"]), "approvals": approvals, "runs": completed, "starts": started, "hashes": events}
    defined = F.coalesce(F.col("_begun") == F.col("_definition"), F.lit(False))
    rows = [df.where(F.col("event_hash").isNotNull()).select("event_hash", F.lit(name).alias("what"), (defined if name == "starts" else F.lit(True)).alias("fits")) for name, df in found.items()]
    counts = reduce(DataFrame.unionByName, rows).groupBy("event_hash").agg(*(F.count_if(F.col("what") == name).alias(name) for name in found), F.bool_and("fits").alias("as_defined"))
    facts = own.select("event_hash", "_actor").join(counts, "event_hash", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = {"actor": ~F.col("_actor").eqNullSafe("human"), "event_hash": zero("hashes") != 1, "proposal": zero("proposals") == 0, "compile": zero("compiles") == 0, "approval": zero("approvals") == 0,
             "completion": zero("runs") != 1, "start": (zero("runs") == 1) & (zero("starts") != 1), "definition": (zero("starts") == 1) & ~F.coalesce("as_defined", F.lit(False))}
    broken = F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items()))))
    return facts.select("event_hash", broken.alias("rule")).distinct()


def _all(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
