"""Text-window features: signals joined to decisions by calendar-day windows, then one conditional aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import slug, zero_if_null
from .joins import asof_backward, asof_forward, range_join


def window_pairs(decisions: DataFrame, signals: DataFrame, days: int, widest: int = 1) -> DataFrame:
    """Decision x signal pairs of (asof_day - widest * days, asof_day], with age in days."""
    pairs = range_join(decisions, signals, ["asset_id"], "asof_day", "avail", days * widest)
    return pairs.withColumn("age", F.col("asof_day") - F.col("avail"))


def _avg(value: Column, where: Column) -> Column:
    return zero_if_null(F.avg(F.when(where, value)))


#: Times as ticks: day numbers and other whole numbers as they are, dates as days, timestamps as microseconds.
DAY_TICKS = {"date": 1, "timestamp": 86_400_000_000}


def _ticks(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    return (F.unix_date(name) if kind == "date" else F.unix_micros(name) if kind == "timestamp" else F.col(name)).cast("long")


def sliding(decisions: DataFrame, signals: DataFrame, by: list[str], at: str, time: str, width: int, states: dict[str, tuple[str, Column]], looks: dict[str, tuple[str, int, int]], distinct: dict[str, Column] | None = None) -> DataFrame:
    """``decisions`` with what their windows hold, found without pairing them with signals.

    ``states``: name -> (sum, min or max; a column of the signals), aggregated once for each pane, a
    pane being one tick of ``time``. ``looks``: result -> (state, youngest and oldest age in
    ticks), the states of those panes combined by a sliding frame. ``distinct``: result -> a column whose
    different values are counted over ages below ``width``: a value counts from its pane until its
    next one or the window's end, so that a running sum of comings and goings is the count.
    Panes are dealt to buckets of time, each to its own and the next, so neither a busy key nor a
    long history is one task. Nothing found: null sums, no distinct values.
    """
    span = max([width, *(oldest + 1 for _, _, oldest in looks.values())])
    own = signals.withColumn("_t", _ticks(signals, time)).where(F.col("_t").isNotNull())
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    panes = own.groupBy(*by, "_t").agg(*(kinds[k](c).alias(f"_s_{n}") for n, (k, c) in states.items()))
    bucket = F.floor(F.col("_t") / span)
    rows = panes.withColumn("_b", F.explode(F.array(bucket, bucket + 1))).withColumn("_d", F.lit(False))
    if distinct:
        named = F.explode(F.array_compact(F.array(*(F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.cast("string").alias("v"))) for name, value in distinct.items()))))
        seen = own.select(*by, "_t", named.alias("_v")).distinct()
        until = F.least(F.lead("_t").over(Window.partitionBy(*by, "_v").orderBy("_t")), F.col("_t") + width)  # one row a pane and value
        spans = seen.withColumn("_e", until)
        first, last = F.floor(F.col("_t") / span), F.floor(F.col("_e") / span)
        change = lambda b, t, n: F.struct(b.alias("_b"), t.alias("_t"), F.lit(n).cast("long").alias("_n"))
        carried = (last > first) & (F.col("_e") > last * span)  # still there when the next bucket begins
        moves = F.array_compact(F.array(change(first, F.col("_t"), 1), F.when(last == first, change(first, F.col("_e"), -1)), F.when(carried, change(last, last * span, 1)), F.when(carried, change(last, F.col("_e"), -1))))
        moved = spans.select(*by, "_v.name", F.explode(moves).alias("m")).groupBy(*by, "m._b", "m._t").agg(*(F.sum(F.when(F.col("name") == n, F.col("m._n"))).alias(f"_n_{n}") for n in distinct))
        rows = rows.unionByName(moved.withColumn("_d", F.lit(False)), allowMissingColumns=True)
    asked = decisions.withColumn("_t", _ticks(decisions, at)).withColumn("_row", F.struct(*decisions.columns)).select(*by, "_t", "_row").withColumn("_b", bucket).withColumn("_d", F.lit(True))
    every = rows.unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy(*by, "_b").orderBy("_t")
    framed = {n: kinds[states[s][0]](f"_s_{s}").over(w.rangeBetween(-oldest, -youngest)) for n, (s, youngest, oldest) in looks.items()}
    counted = {n: F.coalesce(F.sum(f"_n_{n}").over(w.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)) for n in distinct or {}}
    return every.select("_d", "_row", *(c.alias(n) for n, c in (framed | counted).items())).where("_d").select("_row.*", *framed, *counted)


def features(decisions: DataFrame, signals: DataFrame, days: int, event_types: list[str], half_life: float = 3.0) -> DataFrame:
    """One row per decision with the attention, sentiment, source and event features of one window.

    Novel signals (novelty over 0.5) are the evidence; raw columns count duplicates too.
    Decisions without evidence keep zeros and are flagged as missing. Times are day numbers, dates or timestamps.
    """
    day = DAY_TICKS.get(signals.schema["avail"].dataType.typeName(), 1)
    width, half = days * day, -(-days * day // 2)
    novel = F.col("novelty") > 0.5
    s, rel, conf, cred, spam = (F.col(c) for c in ("sentiment", "relevance", "confidence", "credibility", "spam"))
    tick = _ticks(signals, "avail")
    # Decay counts from the start of a stretch of time, of which a window meets two: no power gets large.
    base, grown = 4 * width, lambda t: F.pow(F.lit(2.0), F.pmod(t, F.lit(4 * width)) / (half_life * day))
    lap = F.floor(tick / base) % 2
    quality = conf * rel * cred * (1 - spam)
    weights = {"rel": rel, "conf": conf * rel, "cred": cred * rel * (1 - spam)}
    total = lambda c, where=novel: ("sum", F.when(where, c.cast("double")))
    one = F.lit(1)
    states = {
        "raw": ("sum", one.cast("double")), "ev": total(one), "novelty": ("sum", F.col("novelty").cast("double")), "rated": ("sum", F.when(F.col("novelty").isNotNull(), 1.0)), "s": total(s), "n_s": total(one, novel & s.isNotNull()), "ss": total(s * s),
        "top": ("max", F.when(novel, s)), "bottom": ("min", F.when(novel, s)), "first": ("min", F.when(novel, tick)), "last": ("max", F.when(novel, tick)), "up": total(one, novel & (s > 0.05)), "down": total(one, novel & (s < -0.05)),
        "cred_sum": total(cred), "cred_n": total(one, novel & cred.isNotNull()), "spam_sum": total(spam), "spam_n": total(one, novel & spam.isNotNull()),
        **{f"w_{k}": total(w) for k, w in weights.items()}, **{f"sw_{k}": total(s * w) for k, w in weights.items()}, **{f"e{i}": total(one, novel & (F.col("event_type") == e)) for i, e in enumerate(event_types)},
        **{f"{k}_{p}": total(c * grown(tick), novel & (lap == p)) for p in (0, 1) for k, c in (("decay", one), ("dq", quality), ("sdq", s * quality))}}
    looks = {n: (n, 0, width - 1) for n in states if n != "raw"} | {"raw": ("raw", 0, width - 1), "raw_before": ("raw", width, 2 * width - 1), "ev_before": ("ev", width, 2 * width - 1),
             "s_new": ("s", 0, half - 1), "n_new": ("n_s", 0, half - 1), "any_new": ("ev", 0, half - 1), "s_old": ("s", half, width - 1), "n_old": ("n_s", half, width - 1), "any_old": ("ev", half, width - 1)}
    looks = {f"_{n}": look for n, look in looks.items()}
    different = {f"_{n}": F.when(novel, F.col(c)) for n, c in (("items", "item_id"), ("sources", "source_type"), ("authors", "author"), ("events", "event_type"))}
    out = sliding(decisions, signals, ["asset_id"], "asof_day", "avail", width, states, looks, different)
    v = lambda n: F.coalesce(F.col(f"_{n}"), F.lit(0.0))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    now = _ticks(decisions, "asof_day")
    # What was weighed in the lap of the decision, and in the one before it.
    aged = lambda k: sum((v(f"{k}_{p}") * F.when(F.floor(now / base) % 2 == p, F.lit(1.0) / grown(now)).otherwise(F.pow(F.lit(2.0), -F.lit(base / (half_life * day))) / grown(now)) for p in (0, 1)), F.lit(0.0))
    mean = ratio(v("s"), v("n_s"))
    weighed = lambda a, b: F.when(b > 0, F.try_divide(a, b)).otherwise(0.0)
    abnormal = lambda n, prior: F.when(prior > 0, F.try_divide(n, prior)).otherwise(n)
    new = {
        "raw_text_count": v("raw"), "text_count": v("ev"), "duplicate_item_count": v("raw") - v("ev"), "novelty_share": ratio(v("novelty"), v("rated")), "latest_text_age_days": (now - F.col("_last")) / day, "time_since_first_seen_days": (now - F.col("_first")) / day,
        "attention_unique_item_count": F.col("_items").cast("double"), "source_diversity_count": F.col("_sources").cast("double"), "unique_author_count": F.col("_authors").cast("double"), "event_type_diversity": F.col("_events").cast("double"),
        "sentiment_mean": mean, "sentiment_relevance_weighted": weighed(v("sw_rel"), v("w_rel")), "sentiment_conf_weighted": weighed(v("sw_conf"), v("w_conf")), "sentiment_credibility_weighted": weighed(v("sw_cred"), v("w_cred")), "sentiment_decay_weighted": weighed(aged("sdq"), aged("dq")),
        "sentiment_max_positive": F.greatest(F.lit(0.0), v("top")), "sentiment_max_negative": F.least(F.lit(0.0), v("bottom")), "sentiment_dispersion": F.sqrt(F.greatest(F.lit(0.0), ratio(v("ss"), v("n_s")) - mean * mean)),
        "sentiment_positive_negative_ratio": F.when(v("ev") > 0, (v("up") + 1) / (v("down") + 1)).otherwise(0.0), "sentiment_acceleration": F.when((v("any_new") > 0) & (v("any_old") > 0), ratio(v("s_new"), v("n_new")) - ratio(v("s_old"), v("n_old"))).otherwise(0.0),
        "source_credibility_mean": ratio(v("cred_sum"), v("cred_n")), "spam_score_mean": ratio(v("spam_sum"), v("spam_n")), "text_decay_weight_sum": F.round(aged("decay"), 12), **{f"event_{_slug(e)}_count": v(f"e{i}") for i, e in enumerate(event_types)},
        "text_missing": v("ev") == 0, "mention_velocity": v("ev") / days, "raw_mention_velocity": v("raw") / days, "attention_abnormal": abnormal(v("ev"), v("ev_before")), "raw_attention_abnormal": abnormal(v("raw"), v("raw_before"))}
    return out.select(*decisions.columns, *(c.alias(n) for n, c in new.items()))


def annotation_features(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, and what independent annotations of a window say: counts, coverage, means among those not abstained, evidence, and what is missing.

    ``rows``: abstained (null: not annotated), semantic, raw_confidence, uncertainty,
    event_confidence (all nullable), supporting and counter (evidence counts).
    """
    there, said = F.col("abstained").isNotNull(), F.col("abstained") == False  # noqa: E712
    mean = lambda c, where: zero_if_null(F.avg(F.when(where, F.col(c))))
    none = lambda c, where: F.count(F.when(where, F.col(c))) == 0
    total = lambda c: F.sum(F.when(there, F.coalesce(F.col(c), F.lit(0))).otherwise(0))
    evidence = total("supporting") + total("counter")
    return rows.groupBy(*by).agg(
        F.count_if(there).alias("annotation_count"), F.count_if(said).alias("non_abstention_count"), (F.count_if(there) / F.count(F.lit(1))).alias("annotation_coverage"),
        zero_if_null(F.avg(F.when(there, F.when(said, 0.0).otherwise(1.0)))).alias("abstention_rate"), mean("semantic", said).alias("semantic_mean"), mean("raw_confidence", said).alias("raw_confidence_mean"),
        mean("uncertainty", there).alias("uncertainty_mean"), mean("event_confidence", said).alias("event_confidence_mean"), total("supporting").alias("supporting_evidence_count"),
        total("counter").alias("counterevidence_count"), zero_if_null(F.try_divide(total("supporting"), evidence)).alias("evidence_agreement"), (F.count_if(there) == 0).alias("missing"),
        none("semantic", said).alias("semantic_missing"), none("raw_confidence", said).alias("raw_confidence_missing"), none("uncertainty", there).alias("uncertainty_missing"),
        none("event_confidence", said).alias("event_confidence_missing"), (evidence == 0).alias("evidence_missing"))


def _slug(value: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", "_", value.lower()).strip("_") or "other"


def disagreement(decisions: DataFrame, signals: DataFrame, days: int, by: str) -> DataFrame:
    """asset_id, asof_day, groups, disagreement: population deviation of the means by author or source (two-level aggregation)."""
    pairs = window_pairs(decisions, signals, days).where("novelty > 0.5")
    means = pairs.groupBy("asset_id", "asof_day", by).agg(F.avg("sentiment").alias("m"))
    return means.groupBy("asset_id", "asof_day").agg(F.count(F.lit(1)).alias("groups"), F.stddev_pop("m").alias("disagreement"))


def event_slugs(signals: DataFrame) -> DataFrame:
    return signals.select(slug(F.col("event_type")).alias("slug")).distinct()


def by_source(decisions: DataFrame, signals: DataFrame, days: int, source_types: list[str]) -> DataFrame:
    """One row per decision: count and mean sentiment of the novel signals of each named source, zeros where there are none."""
    day = DAY_TICKS.get(signals.schema["avail"].dataType.typeName(), 1)
    own = lambda t, c: ("sum", F.when((F.col("novelty") > 0.5) & (F.col("source_type") == t), c.cast("double")))
    states = {f"{k}{i}": own(t, c) for i, t in enumerate(source_types) for k, c in (("n", F.lit(1)), ("s", F.col("sentiment")), ("m", F.when(F.col("sentiment").isNotNull(), 1)))}
    out = sliding(decisions, signals, ["asset_id"], "asof_day", "avail", days * day, states, {f"_{n}": (n, 0, days * day - 1) for n in states})
    zero = F.lit(0.0)
    cols = [c for i, t in enumerate(source_types) for c in (F.coalesce(f"_n{i}", zero).alias(f"attention_source_{_slug(t)}_count"), F.coalesce(F.try_divide(f"_s{i}", f"_m{i}"), zero).alias(f"sentiment_source_{_slug(t)}_mean"))]
    return out.select(*decisions.columns, *cols)


def context(decisions: DataFrame, fundamentals: DataFrame, events: DataFrame, blackout: int = 2) -> DataFrame:
    """Decisions with the last known fundamental (value, age in days) and the days to the next event, each with a missing flag."""
    f = fundamentals.select("asset_id", "avail", F.col("avail").alias("_a"), F.col("v").alias("_v"))
    e = events.select("asset_id", "avail", F.col("avail").alias("_n"))
    out = asof_backward(decisions, f, ["asset_id"], "asof_day", "avail", ["_a", "_v"])
    out = asof_forward(out, e, ["asset_id"], "asof_day", "avail", ["_n"])
    days = F.col("_n") - F.col("asof_day")
    return out.withColumns({"fundamental_value": F.coalesce("_v", F.lit(0.0)), "fundamental_missing": F.col("_v").isNull(), "fundamental_age_days": F.col("asof_day") - F.col("_a"), "event_proximity_days": days,
                            "event_missing": days.isNull(), "event_blackout": F.coalesce(days <= blackout, F.lit(False))}).drop("_a", "_v", "_n")
