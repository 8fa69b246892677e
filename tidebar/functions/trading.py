"""Scalar trading arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """``x`` where it is a finite number, else NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def fill_price(price: Column, shares: Column, slippage_bps: Column) -> Column:
    """Price after adverse slippage: buys pay more, sells get less."""
    direction = F.when(shares > 0, 1.0).otherwise(-1.0)
    return price * (1.0 + direction * slippage_bps / 10_000.0)


def commission(
    shares: Column, price: Column, per_share: Column, bps: Column, minimum: Column
) -> Column:
    fee = F.abs(shares) * per_share + F.abs(shares * price) * bps / 10_000.0
    return F.when(shares == 0, 0.0).otherwise(F.greatest(fee, minimum))


def side(shares: Column) -> Column:
    return F.when(shares > 0, "buy").otherwise("sell")


def notional(shares: Column, price: Column) -> Column:
    return shares * price


def slippage_cost(shares: Column, price: Column, reference_price: Column) -> Column:
    return F.abs(shares) * F.abs(price - reference_price)


def whole_shares(shares: Column) -> Column:
    """Toward zero, as a double."""
    return F.when(shares < 0, F.ceil(shares)).otherwise(F.floor(shares)).cast("double")


def order_notional(qty: Column, price: Column, multiplier: Column) -> Column:
    return qty * price * multiplier


def position_weight(shares: Column, price: Column, equity: Column) -> Column:
    return F.coalesce(F.try_divide(shares * price, equity), F.lit(0.0))


def symbol_list(text: Column) -> Column:
    """Distinct upper-case symbols of a comma or space separated text, sorted."""
    parts = F.split(F.upper(text), r"[,\s]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda s: s != "")))


def slug(text: Column) -> Column:
    """Name that is safe in a path; ``run`` when nothing is left."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    short = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 80)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("run"))
