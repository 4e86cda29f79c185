"""Joins in time: ranges by day buckets, backward and forward as-of, interval overlap, membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import settle


def following(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, next: each row with the value of each row of the next larger key; none for the largest.

    Keys are cut into ranges, and the rows of the first key of a range are sent to the range
    before as well, so each range is paired alone. Null keys are left out.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.where(F.col(key).isNotNull()).select(key, F.struct(value).alias("_v"))
    ranges = rows.select(key).repartitionByRange(n, key).withColumn("_part", F.spark_partition_id())
    firsts = sorted(r["first"] for r in ranges.groupBy("_part").agg(F.min(key).alias("first")).collect())  # one row a range
    bounds = F.array(*map(F.lit, firsts)).cast(f"array<{rows.schema[key].dataType.simpleString()}>")
    own = rows.withColumn("_own", F.size(F.filter(bounds, lambda b: b <= F.col(key))))
    dealt = own.withColumn("_part", F.explode(F.when(F.array_contains(bounds, F.col(key)), F.array("_own", F.col("_own") - 1)).otherwise(F.array("_own"))))
    ranked = dealt.withColumn("_rank", F.dense_rank().over(Window.partitionBy("_part").orderBy(key)))
    after = F.collect_list("_v").over(Window.partitionBy("_part").orderBy("_rank").rangeBetween(1, 1))
    pairs = ranked.withColumn("_next", after).where("_own = _part").select(key, F.col(f"_v.{value}").alias(value), F.explode("_next").alias("_next"))
    return pairs.select(key, value, F.col(f"_next.{value}").alias("next"))


def range_join(left: DataFrame, right: DataFrame, by: list[str], at: str, time: str, days: int) -> DataFrame:
    """Pairs with equal ``by`` and at - days < time <= at (day numbers; left-open, right-closed).

    Both sides are dealt to buckets of ``days``; a left row meets two buckets, so the join
    is an equi-join whose groups stay as small as one bucket, however long the series.
    """
    b = F.expr(f"{at} div {days}")
    l = left.withColumn("_b", F.explode(F.array(b, b - 1)))
    r = right.withColumn("_b", F.expr(f"{time} div {days}"))
    return l.join(r, [*by, "_b"]).where((F.col(time) <= F.col(at)) & (F.col(time) > F.col(at) - days)).drop("_b")


def _days(c: Column, kind: str) -> Column:
    """A time as a number of days (numbers are day numbers already)."""
    return F.unix_date(c) if kind == "date" else F.unix_micros(c.cast("timestamp")) / 86_400e6 if kind.startswith("timestamp") else c


def _asof(left: DataFrame, right: DataFrame, by: list[str], at: str, time: str, values: list[str], order: list[str], back: bool, left_first: bool, days: int) -> DataFrame:
    """The nearest right row before (``back``) or after each left row, in buckets of ``days``.

    Each bucket is a window of its own. What the nearest bucket on the far side holds last
    is carried into it as one more row; it is found over one row a bucket, so a key with a
    long history is as many tasks as it has buckets.
    """
    kind = left.schema[at].dataType.simpleString()
    sign = 1 if back else -1
    bucket = lambda c: (F.floor(_days(c, kind) / days) * sign).cast("long")
    payload = F.struct(*(F.col(v) for v in values))
    orders = [f"_o{i}" for i in range(len(order))]
    r = right.select(*by, F.col(time).alias("_t"), *(F.col(o).alias(n) for o, n in zip(order, orders, strict=True)), payload.alias("_v")).where(F.col("_t").isNotNull()).withColumn("_b", bucket(F.col("_t")))
    nearest = F.struct("_t", *orders)
    ends = r.groupBy(*by, "_b").agg((F.max_by if back else F.min_by)("_v", nearest).alias("_v"))
    own = left.withColumn("_b", bucket(F.col(at)))
    # What stands before each bucket that a left row falls into: one row a bucket in this window.
    asked = own.select(*by, "_b").distinct().select(*by, "_b", F.lit(None).cast(ends.schema["_v"].dataType).alias("_v"), F.lit(True).alias("_ask"))
    seen = asked.unionByName(ends.withColumn("_ask", F.lit(False))).groupBy(*by, "_b").agg(F.max("_ask").alias("_ask"), F.first("_v", ignorenulls=True).alias("_v"))
    carried = seen.withColumn("_v", F.last("_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).where(F.col("_ask") & F.col("_v").isNotNull())
    # In a bucket: what is carried, then left and right rows in order of time.
    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    l = own.select(*by, "_b", F.col(at).alias("_t"), F.lit(1 if left_first else 3).alias("_side"), *(nothing(r, o) for o in orders), F.struct(*left.columns).alias("_l"), nothing(r, "_v"))
    side = r.select(*by, "_b", "_t", F.lit(2).alias("_side"), *orders, nothing(l, "_l"), "_v")
    early = carried.select(*by, "_b", nothing(r, "_t"), F.lit(0).alias("_side"), *(nothing(r, o) for o in orders), nothing(l, "_l"), "_v")
    way = (lambda c: F.col(c).asc_nulls_first()) if back else (lambda c: F.col(c).desc_nulls_first())
    w = Window.partitionBy(*by, "_b").orderBy((F.col("_side") != 0), way("_t"), "_side", *(way(o) for o in orders)).rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(side).unionByName(early).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    return out.select("_l.*", *(F.col(f"_v.{v}").alias(v) for v in values))


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], at: str, time: str, values: list[str], order: list[str] | None = None, days: int = 64, strict: bool = False) -> DataFrame:
    """``left`` with the values of the latest right row with time <= at (< if ``strict``), ties by ``order``: null without one."""
    return _asof(left, right, by, at, time, values, order or [], True, strict, days)


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], at: str, time: str, values: list[str], strict: bool = True, days: int = 64) -> DataFrame:
    """``left`` with the values of the earliest right row with time > at (or >=): null without one."""
    return _asof(left, right, by, at, time, values, [], False, strict, days)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Inclusive interval overlap."""
    return (a_start <= b_end) & (b_start <= a_end)


#: Rows of a chunk, rows of the lasting side that a key meets at most, and pairs to look at for each task.
CHUNK, PART, PAIRS = 256, 16_384, 1 << 27


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, members: str | None = None, days: int = 64) -> DataFrame:
    """Pairs (columns of both sides, suffixed _l and _r) with equal ``keys``, overlapping dates (inclusive) and, if given, a common element of ``members``.

    Two intervals overlap where the later one begins. So each interval is cut into the dyadic
    blocks of ``days`` that it fills, two for each doubling of its length at most, and meets by equality the
    beginnings of the others, which stand in one block of each size: a pair is found once, and what
    meets overlaps but for the ends of the smallest blocks. Intervals that end before they begin, and nulls, meet nothing.

    The rows of a block travel as chunks, so that a row of the join holds up to ``CHUNK`` squared
    pairs; a block of many chunks is met in parts, each a key of its own.
    """
    values = [c for c in left.columns if c not in keys]
    bit = lambda m: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(m), F.lit(64)).cast("int"))
    bits = {"_bits": F.coalesce(F.aggregate(members, F.lit(0).cast("long"), lambda seen, m: seen.bitwiseOR(F.when(m.isNotNull(), bit(m)).otherwise(0))), F.lit(0).cast("long"))} if members else {}
    l = _begun(left.withColumns(bits) if bits else left, keys, start, end, days)
    r = l if right is left else _begun(right.withColumns(bits) if bits else right, keys, start, end, days)

    def within(x: str, y: str, later: Column) -> DataFrame:
        pairs = _within(l if x == "l" else r, l if y == "l" else r, keys, start, end, [*bits], values).where(later)
        pairs = pairs.where(F.arrays_overlap(f"x_{members}", f"y_{members}")) if members else pairs  # bits may be shared by chance
        return pairs.select(*keys, *(F.col(f"{'x' if s == x else 'y'}_{c}").alias(f"{c}_{s}") for s in "lr" for c in values))

    return within("l", "r", F.col(f"y_{start}") >= F.col(f"x_{start}")).unionByName(within("r", "l", F.col(f"y_{start}") > F.col(f"x_{start}")))


def overlapping_once(rows: DataFrame, name: str, keys: list[str], start: str, end: str, bits: list[str], days: int = 256) -> DataFrame:
    """keys, {name}_l < {name}_r: as ``overlapping`` of a table with itself, but each pair met in one direction only, members given as the bits of the longs ``bits``."""
    x, y = F.col(f"x_{name}"), F.col(f"y_{name}")
    own = _begun(rows.where(F.col(name).isNotNull()), keys, start, end, days)
    later = (F.col(f"y_{start}") > F.col(f"x_{start}")) & (x != y) | (F.col(f"y_{start}") == F.col(f"x_{start}")) & (x < y)
    return _within(own, own, keys, start, end, bits, [name]).where(later).select(*keys, F.least(x, y).alias(f"{name}_l"), F.greatest(x, y).alias(f"{name}_r"))


def _begun(df: DataFrame, keys: list[str], start: str, end: str, days: int) -> DataFrame:
    """Sound intervals with their first and last smallest block and a number of their own."""
    bucket = lambda c: F.floor(F.unix_date(c) / days)
    return settle(df.dropna(subset=keys).where(F.col(start) <= F.col(end)).withColumns({"_first": bucket(F.col(start)), "_last": bucket(F.col(end)), "_row": F.monotonically_increasing_id()}))


def _within(x: DataFrame, y: DataFrame, keys: list[str], start: str, end: str, bits: list[str], values: list[str]) -> DataFrame:
    """keys, x_ and y_ ``values``, ``start`` and ``end``: pairs in which the row of ``y`` begins on a day up to the end of that of ``x`` and not in a block before it, with a common bit."""
    longest = x.agg(F.max(F.col("_last") - F.col("_first") + 1)).first()[0] or 1
    levels = range(longest.bit_length())  # as many sizes of blocks as the longest interval needs
    carried = list(dict.fromkeys([start, end, *bits, *values]))
    at = [*keys, "_level", "_block"]
    place = lambda level, block: F.struct(F.lit(level).alias("_level"), block.cast("long").alias("_block"))
    fills = []
    for level in levels:  # of the blocks of this size within the interval, those at its ends that are no half of a larger one within it
        low, high = F.ceil(F.col("_first") / 2**level), F.floor((F.col("_last") + 1) / 2**level)
        fills += [F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), place(level, low)), F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), place(level, high - 1))]
    dealt = {"x": F.array_compact(F.array(*fills)), "y": F.array(*(place(level, F.floor(F.col("_first") / 2**level)) for level in levels))}

    # Rows of a block of more than a chunk are dealt to chunks by their numbers, chunks of x to parts, chunks of y to every part.
    counts = [df.groupBy(*keys, "_first", "_last").count().select(*keys, F.inline(dealt[s]), *(F.col("count") * int(s == t) for t in "xy")).toDF(*at, "_x", "_y") for s, df in (("x", x), ("y", y))]
    sizes = settle(counts[0].union(counts[1]).groupBy(*at).agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y")))
    work = sizes.agg(F.sum(F.col("_x").cast("double") * F.col("_y"))).first()[0] or 0
    tasks = max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(work / PAIRS), 20_000)) if work > PAIRS else None  # few bytes make many pairs, so bytes do not tell the tasks
    sizes = sizes.where((F.col("_x") > CHUNK) | (F.col("_y") > CHUNK)).select(*at, F.ceil(F.col("_x") / CHUNK).alias("_nx"), F.ceil(F.col("_y") / CHUNK).alias("_ny"), F.ceil(F.col("_x") / PART).alias("_parts"))

    def chunks(df: DataFrame, s: str) -> DataFrame:
        n = F.col(f"_n{s}")
        rows = df.select(*keys, F.inline(dealt[s]), "_row", *carried).join(sizes, at, "left")
        rows = rows.select(*at, F.when(n > 0, F.pmod(F.xxhash64("_row"), n)).otherwise(0).alias("_chunk"), F.greatest("_parts", F.lit(1)).alias("_parts"), F.struct(*carried).alias("_v"))
        part = F.pmod("_chunk", "_parts") if s == "x" else F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
        out = rows.repartition(*at, "_chunk").groupBy(*at, "_chunk", "_parts").agg(F.collect_list("_v").alias("_c")).select(*at, part.alias("_part"), *(F.col("_c").getField(c).alias(f"{s}s_{c}") for c in carried))
        return out.repartition(tasks, *at, "_part") if tasks else out

    met, xs, ys = chunks(y, "y").join(chunks(x, "x"), [*at, "_part"]), [f"x_{c}" for c in carried], [f"ys_{c}" for c in carried]
    met = met.select(*keys, *ys, *(f"xs_{c}" for c in carried[1:]), F.posexplode(f"xs_{start}").alias("_i", xs[0]))
    met = met.select(*keys, *ys, xs[0], *(F.get(f"xs_{c}", "_i").alias(f"x_{c}") for c in carried[1:]))
    met = met.select(*keys, *ys[1:], *xs, F.posexplode(ys[0]).alias("_j", f"y_{start}"))
    met = met.select(*keys, *xs, f"y_{start}", *(F.get(f"ys_{c}", "_j").alias(f"y_{c}") for c in carried[1:]))
    shared = reduce(Column.bitwiseOR, (F.col(f"x_{b}").bitwiseAND(F.col(f"y_{b}")) for b in bits)) != 0 if bits else F.lit(True)
    return met.where(shared & (F.col(f"y_{start}") <= F.col(f"x_{end}")))


def missing(expected: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    return expected.select(*key).distinct().join(present.select(*key).distinct(), key, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only, with the side: empty for equal sets."""
    return missing(a, b, key).withColumn("side", F.lit("left")).unionByName(missing(b, a, key).withColumn("side", F.lit("right")))


def full_coverage(gold: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """key, status: matched, missing (gold only) or extra (predicted only)."""
    g, p = gold.select(*key).distinct().withColumn("_g", F.lit(1)), predicted.select(*key).distinct().withColumn("_p", F.lit(1))
    return g.join(p, key, "full_outer").select(*key, F.when(F.col("_p").isNull(), "missing").when(F.col("_g").isNull(), "extra").otherwise("matched").alias("status"))


def provenance(claimed: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status of each claimed digest: bound (found as claimed), changed or missing."""
    there = found.select(key, F.col(digest).alias("_found"))
    status = F.when(F.col("_found").isNull(), "missing").when(F.col("_found") != F.col(digest), "changed").otherwise("bound")
    return claimed.join(there, key, "left").select(key, status.alias("status"))
