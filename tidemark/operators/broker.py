"""Order checks as rule columns: each rule that an order breaks is named, so nothing stops at the first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import rule_flags


@dataclass(frozen=True)
class OrderLimits:
    max_open_orders: int = 20
    max_symbol_orders: int = 5
    max_unrealized_loss: float = 100_000.0
    max_price_deviation_bps: float = 300.0
    max_quote_age_seconds: float = 30.0
    max_order_notional: float = 1_000_000.0
    max_position_quantity: float = 1_000.0
    max_symbol_notional: float = 2_000_000.0
    max_gross_notional: float = 5_000_000.0


def tick_size(price: Column) -> Column:
    """The price step of an order at ``price``."""
    return F.when(price <= 3_000, 1.0).when(price <= 5_000, 5.0).when(price <= 30_000, 10.0).when(price <= 50_000, 50.0).otherwise(100.0)


def pretrade(orders: DataFrame, limits: OrderLimits) -> DataFrame:
    """``orders`` with ``failed``: the names of the checks that fail, in a fixed order; empty for an order that may go out.

    ``orders``: side (buy or sell), quantity, limit_price, now and expires_at and quote_at (seconds),
    trading_unit, lower_limit, upper_limit, quote, and the state of the account before it: open_orders,
    symbol_orders, unrealized, soft_limit, buying_power, held, available, pending, symbol_notional,
    pending_symbol_notional, gross_notional, pending_notional, symbol_limit (null: none), unresolved,
    kill_switch. A value that a rule needs and that is missing fails the rule.
    """
    c = F.col
    buy, notional = c("side") == "buy", c("limit_price") * c("quantity")
    lacks = lambda cond: F.coalesce(cond, F.lit(True))
    deviation = F.abs(F.try_divide(c("limit_price"), c("quote")) - 1) * 10_000
    in_symbol = c("symbol_notional") + c("pending_symbol_notional") + notional
    return orders.withColumn("failed", rule_flags(
        ("kill_switch", lacks(c("kill_switch"))), ("unresolved_order", lacks(c("unresolved") > 0)), ("open_orders", lacks(c("open_orders") >= limits.max_open_orders)),
        ("unrealized_loss", lacks(c("unrealized") <= -limits.max_unrealized_loss)), ("symbol_orders", lacks(c("symbol_orders") >= limits.max_symbol_orders)),
        ("side", lacks(~c("side").isin("buy", "sell"))), ("quantity", lacks(c("quantity") <= 0)), ("trading_unit", lacks(F.expr("try_mod(quantity, trading_unit)") != 0)),
        ("tick", lacks(c("limit_price") % tick_size(c("limit_price")) != 0)), ("inconsistent_limits", lacks(c("lower_limit") > c("upper_limit"))),
        ("price_range", lacks(~c("limit_price").between(c("lower_limit"), c("upper_limit")))), ("no_quote", lacks(c("quote") <= 0)),
        ("stale_quote", lacks((c("quote_at") > c("now")) | (c("now") - c("quote_at") > limits.max_quote_age_seconds))), ("quote_deviation", lacks(deviation > limits.max_price_deviation_bps)),
        ("order_notional", lacks((notional <= 0) | (notional > limits.max_order_notional))), ("soft_limit", lacks(notional > c("soft_limit"))), ("buying_power", buy & lacks(notional > c("buying_power"))),
        ("position_quantity", buy & lacks(c("held") + c("pending") + c("quantity") > limits.max_position_quantity)), ("symbol_notional", buy & lacks(in_symbol > limits.max_symbol_notional)),
        ("broker_symbol_limit", buy & (in_symbol > c("symbol_limit"))), ("gross_notional", buy & lacks(c("gross_notional") + c("pending_notional") + notional > limits.max_gross_notional)),
        ("available", (c("side") == "sell") & lacks(c("quantity") > c("available"))), ("expired", lacks(c("expires_at") <= c("now")))))


def match_orders(attempts: DataFrame, orders: DataFrame, key: str, equal: list[str], sent: str, received: str, seconds: int) -> DataFrame:
    """key, candidates, status: the broker's orders that an attempt may have become: all of ``equal`` the same (null like null) and received from one second before to ``seconds`` after it was sent.

    status: matched (one), ambiguous (several) or missing (none). The sides meet on a hash of the
    equal fields, so the join is by key whatever their number.
    """
    digest = lambda: F.xxhash64(*(F.col(c) for c in equal)).alias("_h")
    a = attempts.select(key, sent, *equal, digest())
    o = orders.select(F.col(received).alias("_received"), *(F.col(c).alias(f"_{c}") for c in equal), digest())
    same = F.col(f"_{equal[0]}").eqNullSafe(F.col(equal[0]))
    for c in equal[1:]:
        same = same & F.col(f"_{c}").eqNullSafe(F.col(c))
    near = same & F.col("_received").between(F.col(sent) - 1, F.col(sent) + seconds)
    found = a.join(o, "_h").where(near).groupBy(key).agg(F.count(F.lit(1)).alias("candidates"))
    n = F.coalesce("candidates", F.lit(0))
    return attempts.select(key).join(found, key, "left").select(key, n.alias("candidates"), F.when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("missing").alias("status"))


def cancel_state(fills: DataFrame, key: str, status: str, still_open: str, done: str) -> DataFrame:
    """key, state: cancelled (nothing open), partial (some done, some open) or open."""
    s = fills.groupBy(key).agg(F.bool_or(F.col(status) == still_open).alias("_o"), F.bool_or(F.col(status) == done).alias("_d"))
    return s.select(key, F.when(~F.coalesce("_o", F.lit(False)), "cancelled").when(F.col("_d"), "partial").otherwise("open").alias("state"))


def intent_digest(**fields: Column) -> Column:
    """sha256 of an intent as JSON with its fields in order of name."""
    return F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items())))), 256)
