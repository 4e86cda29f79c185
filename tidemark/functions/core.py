"""Guarded arithmetic, statistics and string helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

FINITE_MAX = 1.7976931348623157e308


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= F.lit(FINITE_MAX))


def finite(c: Column) -> Column:
    """A finite double, or 0.0 for null, NaN, infinite or unparseable values; booleans count 0 and 1."""
    d = c.try_cast("double")
    return F.when(is_finite(d), d).otherwise(0.0)


def simple_return(now: Column, before: Column) -> Column:
    """now / before - 1, and 0.0 where ``before`` is zero; null where either is."""
    return F.when(before == 0, 0.0).otherwise(F.try_divide(now, before) - 1)


def first_numeric(values: Column, names: list[str]) -> Column:
    """The first finite number among the named entries of a map<string,string>."""
    tries = [F.try_element_at(values, F.lit(n)).try_cast("double") for n in names]
    return F.coalesce(*(F.when(is_finite(t), t) for t in tries))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("other"))


def path_component(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def horizon_steps(c: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.regexp_replace(c, "[^0-9]", "").try_cast("int"), F.lit(1)))


def identifier_hash(c: Column, fold: bool = True) -> Column:
    return F.sha2(F.lower(F.trim(c)) if fold else F.trim(c), 256)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: 0.0 if the weights do not sum to more than zero."""
    total = F.sum(weight)
    return F.coalesce(F.when(total > 0, F.sum(value * weight) / total), F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate Pearson correlation: 0.0 for fewer than two rows or a constant side."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))), F.lit(0.0))


def beta_over(x: Column, market: Column, w: WindowSpec) -> Column:
    """Population covariance over variance in a window; null where it is undefined."""
    both = x.isNotNull() & market.isNotNull()
    x, market = F.when(both, x), F.when(both, market)
    return F.when(F.count(market).over(w) >= 2, F.try_divide(F.covar_pop(x, market).over(w), F.var_pop(market).over(w)))


def average_rank(value: Column, by: WindowSpec, ordered: WindowSpec, ties: WindowSpec) -> Column:
    """0-based rank; ties share the mean of their positions."""
    return F.rank().over(ordered) - 1 + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def rule_flags(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that hold, in order; a null condition does not hold."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules)))


def holm(p: Column, ordered: WindowSpec, everything: WindowSpec) -> tuple[Column, Column]:
    """(raw step, window): Holm's factor for the ordered p-values; the running maximum is taken by the caller."""
    m, k = F.count(F.lit(1)).over(everything), F.row_number().over(ordered)
    return F.least(F.lit(1.0), (m - k + 1) * p), k


def uniform_hash(c: Column) -> Column:
    """The first eight bytes of sha256 as an unsigned number, for seeded orders."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def format_utc(c: Column) -> Column:
    """ISO text with a Z; microseconds only where there are any."""
    return F.concat(F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.lit("Z"))


def passthrough(df: DataFrame, names: list[str]) -> list[str]:
    """Those of the optional columns that ``df`` has, in the given order."""
    return [n for n in names if n in df.columns]


def flatten_map(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Named entries of a map as double columns; a name that is a column already raises ValueError."""
    clash = [n for n in names if n in df.columns]
    if clash:
        raise ValueError(f"reserved names: {', '.join(clash)}")
    return df.select(*(c for c in df.columns if c != column), *(F.try_element_at(column, F.lit(n)).cast("double").alias(n) for n in names))


def metric_unit(metric: Column) -> Column:
    """The unit of a reported metric, from its name."""
    return (F.when(metric.isin("dates", "ic_dates", "rows", "periods", "trades"), "count")
            .when(metric.contains("return") | metric.isin("hit_rate", "precision_at_k", "max_drawdown"), "ratio")
            .when(metric.isin("final_equity", "minimum_capacity_proxy_equity"), "equity_multiple")
            .when(metric == "average_holding_period_days", "days").otherwise("coefficient"))


def holding_days(start: Column, end: Column) -> Column:
    """Days between two dates, one at least; null where the end is not after the start."""
    d = F.datediff(end, start).cast("double")
    return F.when(d > 0, F.greatest(F.lit(1.0), d))


def signed_label(label: Column, probability: Column) -> Column:
    """A classifier's label and probability as a score from -1 to 1."""
    low = F.lower(F.trim(label))
    return F.when(low == "positive", probability).when(low == "negative", -probability).otherwise(0.0)


def _blank(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def coerced(c: Column, kind: str) -> tuple[Column, Column]:
    """(value, sound) of a record's field: the value as ``kind``, null where it is blank or malformed; sound unless it is malformed.

    Kinds: str, float (finite), int (at least 1), bool (true/1/yes, false/0/no), datetime (with a zone), date, raw_tradable.
    """
    text = _blank(c)
    word = F.lower(F.trim(text))
    number = text.try_cast("double")
    value = {
        "str": text, "float": F.when(is_finite(number), number), "int": F.when(text.rlike(r"^\s*[+]?[0-9]+\s*$") & (text.try_cast("bigint") >= 1), text.try_cast("bigint")),
        "bool": F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False),
        "datetime": F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), text.try_cast("timestamp")), "date": F.substring(text, 1, 10).try_cast("date"), "raw_tradable": F.when(text == "raw_tradable", text),
    }[kind]
    return value, text.isNull() | value.isNotNull()


def liquidity_bucket(dollar_volume: Column) -> Column:
    """low below 5 million, medium below 50 million, else high; null stays null."""
    return F.when(dollar_volume < 5e6, "low").when(dollar_volume < 5e7, "medium").when(dollar_volume.isNotNull(), "high")


def volatility_bucket(label: Column, ratio: Column, volatility: Column) -> Column:
    """The regime's own name if it has one, else by its ratio to the long run (0.8, 1.2), else by the volatility (0.01, 0.03); null without any."""
    by_ratio = F.when(ratio < 0.8, "low").when(ratio <= 1.2, "normal").otherwise("high")
    by_volatility = F.when(volatility < 0.01, "low").when(volatility < 0.03, "normal").when(volatility.isNotNull(), "high")
    return F.when(label != "", label).when(ratio.isNotNull(), by_ratio).otherwise(by_volatility)


def price_as_known(close: Column, factor: Column, vintage: Column, available: Column) -> Column:
    """The adjusted price, if its adjustment was known by then (vintage no later than what is available); else null."""
    return F.when(vintage <= available, close * F.coalesce(factor, F.lit(1.0)))


def actionable_at(available: Column, decision: Column) -> Column:
    """When a signal can first be acted on: once it is available and a decision is made."""
    return F.greatest(available, decision)


def row_volatility(measured: Column, high: Column, low: Column) -> Column:
    """The measured volatility, never negative; without one the range over the middle price."""
    return F.greatest(F.lit(0.0), F.coalesce(measured, F.try_divide(high - low, (high + low) / 2), F.lit(0.0)))


def probability(text: Column) -> Column:
    """A finite number from 0 to 1 that the text holds, else null."""
    p = text.try_cast("double")
    return F.when(is_finite(p) & p.between(0, 1), p)


#: Fixed value: four-place security codes, without the letters that are not given out.
SECURITY_CODE = "^[1-9][0-9ACDF-HJ-NPR-UW-Y][0-9][0-9ACDF-HJ-NPR-UW-Y]$"


def is_security_code(code: Column) -> Column:
    return F.coalesce(code.rlike(SECURITY_CODE), F.lit(False))


def decay(age: Column, half_life: Column) -> Column:
    """Weight of something ``age`` old: 1 at first, a half after each half-life."""
    return F.pow(F.lit(2.0), -age / half_life)
