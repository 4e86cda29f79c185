"""Event logs as tables: chain checks, per-key state folds, latest states, notional and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chained(events: DataFrame, by: list[str], order: str, payload: Column) -> DataFrame:
    """Adds event_hash (of the payload) and previous_hash (of the event before, '' for the first)."""
    w = Window.partitionBy(*by).orderBy(order)
    return events.withColumn("event_hash", F.sha2(payload, 256)).withColumn("previous_hash", F.coalesce(F.lag("event_hash").over(w), F.lit("")))


def verify_chain(events: DataFrame, by: list[str], order: str, payload: Column, at: str | None = None) -> DataFrame:
    """by, order, broken: rules that a log row breaks (previous hash, sequence, content, and with ``at`` times that never go back); no rows for a sound log."""
    w = Window.partitionBy(*by).orderBy(order)
    rules = {
        "previous_hash": F.col("previous_hash") != F.coalesce(F.lag("event_hash").over(w), F.lit("")),
        "sequence": F.col(order) != F.row_number().over(w) - 1, "content": F.col("event_hash") != F.sha2(payload, 256)}
    if at:
        rules["time"] = F.col(at) < F.lag(at).over(w)
    r = events.withColumn("broken", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items()))))
    return r.where(F.size("broken") > 0).select(*by, order, "broken")


def fold(events: DataFrame, by: list[str], order: str, kind: str, transitions: dict[tuple[str, str], str], start: str, chunk: int = 1024) -> DataFrame:
    """by, state, n_events, n_invalid: each key's events in order through a state machine; an event without a transition is invalid and keeps the state.

    A stretch of a log maps each state to the state after it, and such maps compose. With
    whole-numbered ``order`` a log is cut into stretches of ``chunk`` numbers, each folded by
    itself from every state; a key's task sees one small map for each. Other orders: one stretch.
    """
    states = sorted({start, *(s for s, _ in transitions), *transitions.values()})
    table = F.create_map(*(F.lit(x) for (s, e), t in transitions.items() for x in (f"{s}>{e}", t)))

    def step(a: Column, e: Column) -> Column:
        to = F.element_at(table, F.concat(a["state"], F.lit(">"), e[kind]))
        return F.struct(F.coalesce(to, a["state"]).alias("state"), (a["bad"] + F.when(to.isNull(), 1).otherwise(0)).alias("bad"))

    whole = events.schema[order].dataType.typeName() in ("byte", "short", "integer", "long")
    part = F.floor(F.col(order) / chunk) if whole else F.lit(0).cast("long")
    logs = events.groupBy(*by, part.alias("_part")).agg(F.array_sort(F.collect_list(F.struct(order, kind))).alias("log"))
    from_state = lambda s: F.aggregate("log", F.struct(s.alias("state"), F.lit(0).cast("long").alias("bad")), step)
    maps = logs.select(*by, "_part", F.size("log").cast("long").alias("n"), F.map_from_arrays(F.array(*map(F.lit, states)), F.array(*(from_state(F.lit(s)) for s in states))).alias("m"))
    runs = maps.groupBy(*by).agg(F.sum("n").alias("n_events"), F.array_sort(F.collect_list(F.struct("_part", F.map_entries("m").alias("m")))).alias("runs"))

    def compose(a: Column, run: Column) -> Column:
        to = F.filter(run["m"], lambda e: e["key"] == a["state"])[0]["value"]
        return F.struct(to["state"].alias("state"), (a["bad"] + to["bad"]).alias("bad"))

    first = F.struct(F.lit(start).alias("state"), F.lit(0).cast("long").alias("bad"))
    return runs.withColumn("f", F.aggregate("runs", first, compose)).select(*by, F.col("f.state").alias("state"), "n_events", F.col("f.bad").alias("n_invalid"))


def latest(events: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last event; partial aggregation, so a hot key does not meet in one task."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("v")
    return events.groupBy(*by).agg(last).select(*by, "v.*")


def unresolved(events: DataFrame, by: list[str], order: list[str], kind: str, open_kinds: list[str]) -> DataFrame:
    """Keys whose last state is one of ``open_kinds``."""
    return latest(events, by, order, [kind]).where(F.col(kind).isin(open_kinds))


def daily_notional(events: DataFrame, key: str, day: str, notional: str) -> DataFrame:
    """day, notional, conflicts: each key counts once a day; keys with differing amounts are conflicts and left out."""
    once = events.groupBy(day, key).agg(F.min(notional).alias("lo"), F.max(notional).alias("hi"))
    return once.groupBy(day).agg(F.sum(F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(0.0)).alias("notional"), F.count_if(F.col("lo") != F.col("hi")).alias("conflicts"))
