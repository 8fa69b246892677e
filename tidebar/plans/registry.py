"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.markettime import utc_clock

# Added before rounding on both sides: prices divided by a power of two end exactly
# on a rounding border, where the two engines round differently.
NUDGE = 1.234e-8

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        name = function.__name__
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def shown(df: DataFrame, digits: int = 6, plain: tuple[str, ...] = (), **special: int) -> DataFrame:
    """Comparable output: rounded doubles and naive UTC timestamps.

    Columns in ``plain`` stay as they are; ``special`` sets digits per column.
    """
    out = []
    for field in df.schema.fields:
        column = F.col(field.name)
        kind = field.dataType.typeName()
        if kind == "double" and field.name not in plain:
            column = F.round(column + NUDGE, special.get(field.name, digits)) + F.lit(0.0)
        elif kind == "timestamp":
            column = utc_clock(column)
        out.append(column.alias(field.name))
    return df.select(*out)


def cents(df: DataFrame, *names: str) -> DataFrame:
    """Exact sums of amounts, shown with two digits.

    Rounded as decimals, a half goes the same way in both engines.
    """
    exact = {n: F.round(F.col(n).cast("decimal(38,6)"), 2).cast("double") for n in names}
    return df.withColumns(exact)
