"""The walk-forward protocol: complete cross-sections, embargo, a frozen holdout, families with uncertainty, and their evaluation.

``rows`` have decision, avail (when the label is known; null: never), y (null: no outcome yet)
and features; decision and avail are day numbers, dates or timestamps. Everything about
decisions is computed over one row a decision; everything about labels over sums taken
once for each time at which labels become known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_backward
from .models import prediction_metrics, unpivot

#: Families without a fit: the same score for all, the longest momentum there is, none.
BENCHMARKS = ("equal_weight", "momentum_only", "no_trade")
MOMENTUM = ("return_20d", "return_5d", "return_3d", "return_1d")
DEVELOPMENT, PURGED, HOLDOUT = "development", "purged", "final_holdout"
WALK, FROZEN = "development_walk_forward", "frozen_final_holdout"
#: Variances up to here are rounding.
FLAT = 1e-12


def cross_sections(rows: DataFrame) -> DataFrame:
    """decision, n, observed, known_at, status of each decision.

    observed: every row has its outcome; censored: none has, and nothing says that it should
    be known by the last decision; partial and uncovered break the protocol, for using what is
    there would select assets by what became known later.
    """
    last = rows.agg(F.max("decision").alias("d")).scalar()
    s = rows.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("observed"), F.max("avail").alias("known_at"), F.count_if(F.col("avail").isNull() | (F.col("avail") <= last)).alias("_due"))
    return s.withColumn("status", F.when(F.col("observed") == F.col("n"), "observed").when(F.col("observed") > 0, "partial").when((F.col("_due") > 0) & F.col("known_at").isNotNull(), "uncovered").otherwise("censored")).drop("_due")


def windows(rows: DataFrame, holdout: int) -> DataFrame:
    """decision, window, holdout_start of each observed decision: the last ``holdout`` are the final holdout; the decisions
    before it, from the first whose labels aren't all known before it starts, are purged; the others are for development."""
    if holdout < 0:
        raise ValueError("holdout must not be negative")
    seen = cross_sections(rows).where("status = 'observed'")
    back = Window.orderBy(F.desc("decision"))  # one row a decision
    placed = seen.withColumn("_back", F.row_number().over(back))
    placed = placed.withColumn("holdout_start", F.max(F.when(F.col("_back") == holdout, F.col("decision"))).over(Window.partitionBy()))
    late = (F.col("_back") > holdout) & (F.col("known_at") >= F.col("holdout_start"))
    first_late = F.min(F.when(late, F.col("decision"))).over(Window.partitionBy())
    window = F.when(F.col("_back") <= holdout, HOLDOUT).when(F.col("decision") >= first_late, PURGED).otherwise(DEVELOPMENT)
    return placed.select("decision", window.alias("window"), "holdout_start")


def cutoffs(rows: DataFrame, embargo: int = 0, holdout: int = 0) -> DataFrame:
    """decision, cutoff, role of every decision: only labels known before the cutoff train it.

    The cutoff lies ``embargo`` decisions back (the first decision at most). From the start of
    the holdout on it stays where it was for the holdout's first decision.
    """
    if embargo < 0:
        raise ValueError("embargo must not be negative")
    every = rows.select("decision").distinct()
    if holdout:
        start = windows(rows, holdout).agg(F.max("holdout_start").alias("holdout_start"))
        every = every.join(F.broadcast(start), how="cross")  # one row
    else:
        every = every.withColumn("holdout_start", F.lit(None).cast(rows.schema["decision"].dataType))
    frozen = F.coalesce(F.col("decision") >= F.col("holdout_start"), F.lit(False))
    order = Window.orderBy("decision")  # one row a decision, here and below
    own = F.coalesce(F.lag("decision", embargo).over(order), F.min("decision").over(Window.partitionBy()))
    first = F.min(F.when(frozen, F.col("_own"))).over(Window.partitionBy())
    return every.withColumn("_own", own).select("decision", F.when(frozen, first).otherwise(F.col("_own")).alias("cutoff"), F.when(frozen, FROZEN).otherwise(WALK).alias("role"), "holdout_start")


def key_number(key: Column) -> Column:
    """60 bits of a training key's md5; their sum names a set of keys, whatever the order."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")


def train(rows: DataFrame, families: dict[str, list[str]], key: Column, min_rows: int = 0, embargo: int = 0, holdout: int = 0, strict: bool = True) -> DataFrame:
    """decision, cutoff, role, family, feature, n, mean, scale, weight, residual_scale, key_digest: every family's snapshot for every decision.

    Trained on observed decisions (before the holdout, if there is one) whose labels are known before the cutoff.
    Weights are the features' correlations with the outcome over the sum of their sizes;
    residual_scale is the outcome's standard deviation. Under ``min_rows`` rows a snapshot is
    empty: mean 0, scale 1, weight 0, no rows. A missing feature counts as 0. With ``strict``, partial
    and uncovered decisions are an error; otherwise they are left out whole.
    """
    if not families or not all(families.values()):
        raise ValueError("families must have features")
    whole = cross_sections(rows)
    if strict and whole.where("status IN ('partial', 'uncovered')").limit(1).count():
        raise ValueError("decisions whose outcomes are known in part, or not although they are due, would select by what became known later")
    features = sorted({f for own in families.values() for f in own})
    at = cutoffs(rows, embargo, holdout)
    start = at.agg(F.max("holdout_start").alias("s")).scalar()
    usable = rows.join(whole.where("status = 'observed'").select("decision"), "decision", "left_semi").where(F.col("avail").isNotNull() & (start.isNull() | (F.col("decision") < start)))
    # Once for each time at which labels become known: what they add to all sums.
    x, y = F.col("x"), F.col("y")
    kept = usable.select("avail", "y", key_number(key).alias("_key"), *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features))
    long = unpivot(kept, ["avail", "y", "_key"], features)
    added = long.groupBy("feature", "avail").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.sum("_key").alias("keys"))
    until = Window.partitionBy("feature").orderBy("avail").rowsBetween(Window.unboundedPreceding, 0)
    sums = ["n", "sx", "sxx", "sy", "syy", "sxy", "keys"]
    running = added.select("feature", "avail", *(F.sum(c).over(until).alias(c) for c in sums))
    asked = at.select("cutoff").distinct().withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    s = asof_backward(asked, running, ["feature"], "cutoff", "avail", sums, strict=True)
    n = F.coalesce("n", F.lit(0))
    var = lambda a, b: F.greatest(F.lit(0.0), F.col(b) / n - F.pow(F.col(a) / n, 2))
    s = s.withColumns({"_vx": F.when(n > 0, var("sx", "sxx")).otherwise(0.0), "_vy": F.when(n > 0, var("sy", "syy")).otherwise(0.0)})
    varies = (F.col("_vx") > FLAT) & (F.col("_vy") > FLAT)
    s = s.withColumn("_r", F.when(varies, F.try_divide(F.col("sxy") / n - F.col("sx") * F.col("sy") / n / n, F.sqrt(F.col("_vx") * F.col("_vy")))).otherwise(0.0))
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("family"), F.lit(f).alias("feature")) for name, own in families.items() for f in dict.fromkeys(own)))).alias("p")
    own = at.select("decision", "cutoff", "role", pairs).select("decision", "cutoff", "role", "p.*").join(s, ["cutoff", "feature"])
    trained = (n >= min_rows) & (n > 0)
    total = F.sum(F.abs("_r")).over(Window.partitionBy("decision", "family"))  # a family's features
    return own.select(
        "decision", "cutoff", "role", "family", "feature", F.when(trained, n).otherwise(0).cast("bigint").alias("n"), F.when(trained, F.col("sx") / n).otherwise(0.0).alias("mean"),
        F.when(trained & (F.col("_vx") > FLAT), F.sqrt("_vx")).otherwise(1.0).alias("scale"), F.when(trained & (total > 0), F.try_divide(F.col("_r"), total)).otherwise(0.0).alias("weight"),
        F.when(trained & (F.col("_vy") > FLAT), F.sqrt("_vy")).otherwise(0.0).alias("residual_scale"), F.when(trained, F.col("keys").cast("string")).otherwise("0").alias("key_digest"))


def predict(rows: DataFrame, snapshots: DataFrame, families: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """family, keys, decision, score, uncertainty, training_rows: each row scored by its decision's own snapshots, and by the benchmarks.

    A benchmark has no uncertainty and no training rows. Momentum is the first of ``MOMENTUM`` that ``rows`` has, 0 without one.
    """
    features = sorted({f for own in families.values() for f in own})
    long = unpivot(rows.select(*keys, "decision", *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features)), [*keys, "decision"], features)
    z = (F.col("x") - F.col("mean")) / F.col("scale") * F.col("weight")
    fitted = long.join(snapshots, ["decision", "feature"]).groupBy("family", *keys, "decision").agg(F.sum(z).alias("score"), F.max("residual_scale").alias("uncertainty"), F.max("n").alias("training_rows"))
    moves = next((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in MOMENTUM if c in rows.columns), F.lit(0.0))
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("family"), c.alias("score")) for n, c in zip(BENCHMARKS, (F.lit(1.0), moves, F.lit(0.0)), strict=True)))).alias("b")
    plain = rows.select(named, *keys, "decision").select("b.family", *keys, "decision", "b.score", F.lit(None).cast("double").alias("uncertainty"), F.lit(0).cast("bigint").alias("training_rows"))
    return fitted.unionByName(plain)


def protocol(rows: DataFrame, snapshots: DataFrame, holdout: int) -> DataFrame:
    """One row: what the training promises of its holdout. holdout_start, holdout_periods, frozen_decision, cutoff, training_rows, key_digest; all null but the periods without a holdout."""
    w = windows(rows, holdout).where(F.col("window") == HOLDOUT).agg(F.min("decision").alias("holdout_start"), F.count(F.lit(1)).alias("holdout_periods"))
    frozen = snapshots.where(F.col("role") == FROZEN)
    pick = lambda c: F.min_by(c, "decision").alias(c)
    f = frozen.agg(F.min("decision").alias("frozen_decision"), pick("cutoff"), F.max("n").alias("training_rows"), F.max("key_digest").alias("key_digest"))
    return w.join(f, how="cross")  # one row each


def protocol_violations(claimed: DataFrame, rows: DataFrame, snapshots: DataFrame, holdout: int) -> DataFrame:
    """The rules that a ``protocol`` row (or several) breaks, an array ``broken`` in fixed order; sound ones give an empty array.

    ``snapshots`` are those the predictions were made with: after the holdout's start none
    may be trained on more than the frozen one.
    """
    real = windows(rows, holdout).where(F.col("window") == HOLDOUT).agg(F.min("decision").alias("_start"), F.count(F.lit(1)).alias("_periods"))
    thawed = snapshots.join(F.broadcast(real), F.col("decision") >= F.col("_start")).agg(F.count_distinct("cutoff", "key_digest", "n", "role").alias("_states"), F.max("cutoff").alias("_cutoff"))
    rules = {
        "disabled": F.col("holdout_start").isNull(), "holdout_start": ~F.col("holdout_start").eqNullSafe(F.col("_start")), "holdout_periods": ~F.col("holdout_periods").eqNullSafe(F.col("_periods")),
        "cutoff_after_start": F.coalesce(F.col("cutoff") > F.col("_start"), F.lit(True)), "frozen_after_start": F.coalesce(F.col("frozen_decision") > F.col("_start"), F.lit(True)),
        "updated_in_holdout": (F.col("_states") > 1) | ~F.col("_cutoff").eqNullSafe(F.col("cutoff"))}
    return claimed.join(real, how="cross").join(thawed, how="cross").select(*claimed.columns, F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items()))).alias("broken"))


def evaluate(predictions: DataFrame, rows: DataFrame, keys: list[str], holdout: int = 0, k: int = 10) -> DataFrame:
    """family, window and all diagnostics of ``prediction_metrics``, of development and final holdout apart; purged and unobserved decisions are in neither.

    Nothing of the holdout enters the development rows. ``predictions`` as from ``predict``, of which every family must cover the same rows.
    """
    w = windows(rows, holdout).where(F.col("window") != PURGED).select("decision", "window")
    own = predictions.join(rows.select(*keys, "y"), keys).join(w, "decision").withColumn("expected", F.lit(None).cast("double"))
    return prediction_metrics(own, ["family", "window"], "decision", k)


def uneven_families(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """family, keys, problem: rows that a family lacks although another has them, or has more than once."""
    n = predictions.groupBy("family", *keys).agg(F.count(F.lit(1)).alias("n"))
    every = predictions.select("family").distinct().join(predictions.select(*keys).distinct(), how="cross")  # families are few
    return every.join(n, ["family", *keys], "left").where(F.coalesce("n", F.lit(0)) != 1).select("family", *keys, F.when(F.col("n").isNull(), "missing").otherwise("repeated").alias("problem"))
