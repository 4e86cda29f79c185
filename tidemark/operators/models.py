"""Walk-forward linear scorers and prediction evaluation, all set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import correlation
from .joins import asof_backward


def unpivot(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("u")).select(*keys, "u.feature", "u.x")


def walk_forward(rows: DataFrame, features: list[str], min_rows: int = 20) -> DataFrame:
    """decision, feature, n, mean, scale, weight: a snapshot for every decision day, from labels available strictly before it.

    ``rows``: decision (day), avail (day the label is known), y, and the features. Sums
    are taken once per availability day, accumulated, and met by as-of join: no
    decision re-reads its history.
    """
    long = unpivot(rows.where("y is not null and avail is not null"), ["avail", "y"], features)
    x, y = F.col("x"), F.col("y")
    daily = long.groupBy("feature", "avail").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    w = Window.partitionBy("feature").orderBy("avail").rowsBetween(Window.unboundedPreceding, 0)
    sums = ["n", "sx", "sxx", "sy", "syy", "sxy"]
    running = daily.select("feature", "avail", *(F.sum(c).over(w).alias(c) for c in sums)).withColumn("known", F.col("avail") + 1)  # strictly before
    decisions = rows.select("decision").distinct().withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    s = asof_backward(decisions, running, ["feature"], "decision", "known", sums)
    n = F.col("n")
    vx, vy = F.col("sxx") / n - F.pow(F.col("sx") / n, 2), F.col("syy") / n - F.pow(F.col("sy") / n, 2)
    s = s.withColumns({"mean": F.col("sx") / n, "_vx": F.when(vx > 1e-12, vx).otherwise(0.0), "_vy": F.when(vy > 1e-12, vy).otherwise(0.0), "_c": F.col("sxy") / n - F.col("sx") * F.col("sy") / n / n})
    s = s.withColumn("_r", F.when((n >= 2) & (F.col("_vx") > 0) & (F.col("_vy") > 0), F.try_divide(F.col("_c"), F.sqrt(F.col("_vx") * F.col("_vy")))).otherwise(0.0))
    total = F.sum(F.abs("_r")).over(Window.partitionBy("decision"))
    trained = n >= min_rows
    return s.select("decision", "feature", F.coalesce("n", F.lit(0)).alias("n"), F.when(trained, F.col("mean")).otherwise(0.0).alias("mean"),
                    F.when(trained & (F.col("_vx") > 0), F.sqrt("_vx")).otherwise(1.0).alias("scale"), F.when(trained & (total > 0), F.try_divide(F.col("_r"), total)).otherwise(0.0).alias("weight"))


def predict(rows: DataFrame, snapshots: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """keys, score: sum of (x - mean) / scale * weight; a missing feature counts as 0."""
    long = unpivot(rows.fillna(0.0, subset=features), [*keys, "decision"], features)
    return long.join(snapshots.select("decision", "feature", "mean", "scale", "weight"), ["decision", "feature"]).groupBy(*keys).agg(F.sum((F.col("x") - F.col("mean")) / F.col("scale") * F.col("weight")).alias("score"))


def _placed(rows: DataFrame, by: list[str], value: str, descending: bool = False) -> DataFrame:
    """by, value, _n, _pos (rows of y > 0), _before: for each distinct value how many rows stand before it.

    Counts of values are aggregated by task first; the window runs over distinct values.
    """
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("y") > 0).alias("_pos"))
    order = F.desc(value) if descending else F.col(value)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def precision_at_k(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, precision: share of positive outcomes among the k highest scores; ties at the cutoff share the places left."""
    placed = _placed(rows, by, "score", descending=True)
    depth = F.least(F.lit(k), F.sum("_n").over(Window.partitionBy(*by)))
    top = placed.withColumn("_depth", depth).where("_before < _depth")
    share = F.least(F.lit(1.0), (F.col("_depth") - F.col("_before")) / F.col("_n"))
    return top.groupBy(*by).agg((F.sum(F.col("_pos") * share) / F.max("_depth")).alias("precision"))


def daily_ic(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, n, pearson, spearman of score and y: ties take their average rank."""
    r = rows
    for c in ("score", "y"):
        r = r.join(_placed(rows, by, c).select(*by, c, (F.col("_before") + (F.col("_n") - 1) / 2).alias(f"_r{c}")), [*by, c])
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("score"), F.col("y")).alias("pearson"), correlation(F.col("_rscore"), F.col("_ry")).alias("spearman"))


def prediction_metrics(rows: DataFrame, by: list[str], at: str, k: int = 10) -> DataFrame:
    """One row of all diagnostics for each group: pooled and mean daily correlations, hit rate, precision and squared error.

    ``rows``: score, y, and expected for the squared error (null if any row lacks it). Days of
    one row have no correlation. Nothing is fitted or selected.
    """
    hit = F.avg(F.when(F.col("score") * F.col("y") > 0, 1.0).otherwise(0.0))
    error = F.when(F.count("expected") == F.count(F.lit(1)), F.avg(F.pow(F.col("expected") - F.col("y"), 2)))
    head = rows.groupBy(*by).agg(F.count_distinct(at).alias("dates"), hit.alias("hit_rate"), error.alias("mean_squared_error"))
    pooled = daily_ic(rows, by).select(*by, F.col("n").alias("rows"), F.col("pearson").alias("pearson_ic"), F.col("spearman").alias("spearman_ic"))
    daily = daily_ic(rows, [*by, at]).where("n >= 2").groupBy(*by).agg(F.count(F.lit(1)).alias("ic_dates"), F.avg("pearson").alias("mean_daily_pearson_ic"), F.avg("spearman").alias("mean_daily_spearman_ic"))
    at_k = precision_at_k(rows, by, k).withColumnRenamed("precision", "precision_at_k")
    daily_k = precision_at_k(rows, [*by, at], k).groupBy(*by).agg(F.avg("precision").alias("mean_daily_precision_at_k"))
    out = head.join(pooled, by).join(daily, by, "left").join(at_k, by).join(daily_k, by)
    return out.fillna(0, subset=["ic_dates", "mean_daily_pearson_ic", "mean_daily_spearman_ic"])


def segments(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """``rows`` once for each segment ("dimension: value") that they belong to; a dimension may have several values (an array) or none."""
    kinds = dict(rows.select(*(c.alias(n) for n, c in dimensions.items())).dtypes)
    named = lambda n: lambda v: F.when(v != "", F.concat(F.lit(f"{n}: "), v))
    every = [F.transform(c if kinds[n].startswith("array") else F.array(c), named(n)) for n, c in dimensions.items()]
    return rows.withColumn("segment", F.explode(F.array_compact(F.concat(*every))))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, rows, mean_probability, observed_rate, of ``p`` and a binary ``y``; the last bin is closed."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean_probability"), F.avg(F.col("y").cast("double")).alias("observed_rate"))


def classification(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row: rows, brier, ece."""
    c = calibration(rows, bins)
    ece = c.agg(F.sum(F.col("rows") * F.abs(F.col("mean_probability") - F.col("observed_rate"))).alias("e"))
    head = rows.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    return head.select("rows", "brier", F.try_divide(ece.scalar(), F.col("rows")).alias("ece"))


def macro_f1(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """label, f1 from gold and predicted columns; a label without any true or predicted row counts 0."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), F.lit(0).alias("t")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), (F.col("gold") == F.col("predicted")).cast("int").alias("t")))).alias("z")).select("z.*")
    s = both.groupBy("label").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    return s.where(F.col("label").isin(labels)).select("label", F.coalesce(F.try_divide(2.0 * F.col("t"), (F.col("g") + F.col("p")).cast("double")), F.lit(0.0)).alias("f1"))


def macro_mean(pairs: DataFrame, gold: str, predicted: str, by: list[str]) -> DataFrame:
    """by, macro_f1: the mean F1 of every label that gold or predicted holds in the group."""
    count = lambda g, p: F.struct(g.alias("label"), F.lit(1 if p is None else 0).alias("g"), F.lit(0 if p is None else 1).alias("p"))
    both = pairs.select(*by, F.explode(F.array(count(F.col(gold), None), count(F.col(predicted), 1))).alias("z"), (F.col(gold) == F.col(predicted)).cast("int").alias("same")).select(*by, "z.*", "same")
    s = both.groupBy(*by, "label").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum(F.col("g") * F.col("same")).alias("t"))
    return s.groupBy(*by).agg(F.avg(2.0 * F.col("t") / (F.col("g") + F.col("p"))).alias("macro_f1"))


def annotation_quality(gold: DataFrame, predicted: DataFrame, key: list[str], by: list[str], bins: int = 10) -> DataFrame:
    """One row a group: F1 of stance and event, precision of evidence and counterevidence, horizons, abstention, invalid answers, Brier and calibration error.

    ``gold``: key, by, stance, event, supporting, counter (arrays of span ids), horizon. ``predicted``:
    key, stance, event, supporting, counter, horizon, confidence. A gold row without a prediction is an
    invalid answer: wrong, with confidence 0.
    """
    p = predicted.select(*key, *(F.col(c).alias(f"p_{c}") for c in ("stance", "event", "supporting", "counter", "horizon", "confidence")), F.lit(True).alias("_there"))
    x = gold.join(p, key, "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    invalid, abstains = ~F.col("_there"), F.col("p_stance") == "abstain"
    x = x.withColumns({
        "event": F.coalesce("event", F.lit("none")), "p_event": F.when(invalid, "invalid").when(abstains, "abstain").otherwise(F.coalesce("p_event", F.lit("none"))),
        "p_stance": F.when(invalid, "invalid").otherwise(F.col("p_stance")), "_p": F.when(invalid, 0.0).otherwise(F.col("p_confidence"))})
    x = x.withColumn("_y", (F.col("p_stance") == F.col("stance")).cast("double"))
    common = lambda a, b: F.sum(F.size(F.array_intersect(F.col(a), F.col(b))))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    cited = lambda c: F.sum(F.when(F.col("_there"), F.size(c)).otherwise(0))
    head = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entities"), share(common("p_supporting", "supporting"), cited("p_supporting")).alias("evidence_precision"), share(common("p_counter", "counter"), cited("p_counter")).alias("counterevidence_precision"),
        F.avg(F.when(F.col("p_horizon").eqNullSafe(F.col("horizon")) & F.col("_there"), 1.0).otherwise(0.0)).alias("horizon_accuracy"), F.avg(F.when(F.col("_there") & abstains, 1.0).otherwise(0.0)).alias("abstention_rate"),
        F.avg(F.when(invalid, 1.0).otherwise(0.0)).alias("invalid_rate"), F.avg(F.pow(F.col("_p") - F.col("_y"), 2)).alias("brier"))
    bin_of = F.least(F.lit(bins - 1), F.floor(F.col("_p") * bins))
    error = x.groupBy(*by, bin_of.alias("bin")).agg(F.sum("_p").alias("p"), F.sum("_y").alias("y")).groupBy(*by).agg(F.sum(F.abs(F.col("y") - F.col("p"))).alias("_e"))
    out = head.join(error, by).withColumn("calibration_error", F.col("_e") / F.col("entities")).drop("_e")
    for n in ("stance", "event"):
        out = out.join(macro_mean(x, n, f"p_{n}", by).withColumnRenamed("macro_f1", f"{n}_macro_f1"), by)
    return out


# What the names of a feature family begin with.
FAMILY_PREFIXES = {"text": ("text_", "sentiment_", "attention_", "event_", "source_", "novelty_", "mention_", "spam_"), "llm": ("llm_",)}


def families(columns: list[str]) -> dict[str, list[str]]:
    """Feature families by name: traditional is what is neither text nor llm; the others are unions."""
    text = [c for c in columns if c.startswith(FAMILY_PREFIXES["text"])]
    llm = [c for c in columns if c.startswith(FAMILY_PREFIXES["llm"])]
    plain = [c for c in columns if c not in {*text, *llm}]
    return {"traditional": plain, "text": text, "llm": llm, "combined": plain + text, "traditional_llm": plain + llm, "all": plain + text + llm}


def fit(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, n, mean, scale (1 where constant), weight (correlation with y, absolute values summing to 1): one batch fit."""
    long = unpivot(rows.where("y is not null"), ["y"], features)
    s = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("_s"), correlation(F.col("x"), F.col("y")).alias("_r"))
    total = F.sum(F.abs("_r")).over(Window.partitionBy())  # one row per feature
    return s.select("feature", "n", "mean", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0).alias("scale"), F.when(total > 0, F.try_divide(F.col("_r"), total)).otherwise(0.0).alias("weight"))


def frozen(rows: DataFrame, snapshots: DataFrame, cutoff: int, features: list[str], keys: list[str]) -> DataFrame:
    """keys, score of the rows after ``cutoff`` by the one snapshot that was last at it: nothing later is learned."""
    last = snapshots.where(F.col("decision") <= cutoff)
    last = last.groupBy("feature").agg(F.max_by(F.struct("mean", "scale", "weight"), "decision").alias("m")).select("feature", "m.*")
    long = unpivot(rows.where(F.col("decision") > cutoff).fillna(0.0, subset=features), keys, features)
    return long.join(last, "feature").groupBy(*keys).agg(F.sum((F.col("x") - F.col("mean")) / F.col("scale") * F.col("weight")).alias("score"))


def evaluate(rows: DataFrame, segment: str, at: str) -> DataFrame:
    """segment, rows, dates, mean_ic (mean of the daily correlations), hit_rate, mse of score and y."""
    daily = rows.groupBy(segment, at).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("score"), F.col("y")).alias("ic"), F.sum(F.when(F.col("score") * F.col("y") > 0, 1.0).otherwise(0.0)).alias("h"),
                                          F.sum(F.pow(F.col("score") - F.col("y"), 2)).alias("e"))
    n = F.sum("n")
    return daily.groupBy(segment).agg(n.alias("rows"), F.count(F.lit(1)).alias("dates"), F.avg("ic").alias("mean_ic"), (F.sum("h") / n).alias("hit_rate"), (F.sum("e") / n).alias("mse"))


def accuracy(rows: DataFrame, gold: Column, predicted: Column, by: list[str]) -> DataFrame:
    """by, n, accuracy: how often the prediction equals the gold value; rows without a gold value are left out."""
    own = rows.select(*by, gold.alias("_g"), predicted.alias("_p")).where("_g is not null")
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce((F.col("_g") == F.col("_p")).cast("int"), F.lit(0))).alias("accuracy"))


def subgroup_effects(rows: DataFrame, dimensions: dict[str, Column], effect: Column) -> DataFrame:
    """dimension, value, n, effect: the mean effect in each value of each dimension; one pass, each row counts once a dimension."""
    dims = F.array(*(F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value")) for n, c in dimensions.items()))
    x = rows.select(F.explode(dims).alias("d"), effect.alias("e")).select("d.*", "e").where("value is not null")
    return x.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("effect"))


def rubric(rows: DataFrame, points: dict[str, Column], by: list[str]) -> DataFrame:
    """``rows`` with total (the points of all criteria, missing ones 0) and place within ``by``, ties sharing the better one."""
    total = sum((F.coalesce(c, F.lit(0)) for c in points.values()), F.lit(0)).cast("long")
    return rows.withColumn("total", total).withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("total"))))


def metric_deltas(baseline: DataFrame, enhanced: DataFrame, by: list[str]) -> DataFrame:
    """by, metric_id, delta: enhanced less baseline over the metrics that both have as finite numbers. Both: by, metric_id, value."""
    finite = lambda df, n: df.select(*by, "metric_id", F.col("value").alias(n)).where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return finite(baseline, "_b").join(finite(enhanced, "_e"), [*by, "metric_id"]).select(*by, "metric_id", (F.col("_e") - F.col("_b")).alias("delta"))


def score_families(rows: DataFrame, families: dict[str, Column]) -> DataFrame:
    """``rows`` once for each family of scores: family, score."""
    each = F.array(*(F.struct(F.lit(n).alias("family"), c.cast("double").alias("score")) for n, c in families.items()))
    return rows.withColumn("_f", F.explode(each)).select("*", "_f.*").drop("_f")


def select_top(rows: DataFrame, by: list[str], order: Column, k: int, name: str = "asset_id") -> DataFrame:
    """The first ``k`` rows of each decision by ``order`` (nulls left out), ties by name, with their place ``k``."""
    own = rows.withColumn("_o", order).where("_o is not null")
    return own.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("_o", name))).where(F.col("k") <= k).drop("_o")


def random_order(seed: int, *key: Column) -> Column:
    """An order that depends on the seed and the row's key alone, whatever the partitions."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in key)), 256)
