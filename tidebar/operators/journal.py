"""Order checks and journal roll-ups. Days are UTC days."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.functions.markettime import from_utc, utc_clock
from tidebar.functions.trading import order_notional
from tidebar.schemas import JOURNAL

# Amounts are added up as decimals of cents, so no sum depends on its order.
MONEY = "decimal(28,2)"


@dataclass(frozen=True)
class Limits:
    """Rules an order has to pass."""

    max_notional: float = 500.0
    max_daily_orders: int = 10
    allow_live: bool = False


#: What a pattern for white space at the ends of a text can begin or end at (fixed values).
_EDGES = " \t\n\x0b\f\r\x85\u2028\u2029"


def _once(rows: DataFrame, value: Column, name: str, others: list[str]) -> DataFrame:
    """The columns ``others`` and ``value`` as ``name``, worked out once for each row.

    A filter on a selected column is moved below the selection and repeats its expression for
    each time that it is mentioned; it is not moved below a generator.
    """
    return rows.select(*others, F.explode(F.array(value)).alias(name))


def judged_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are not blank, trimmed as ``line``, with ``entry`` (texts) and whether it is ``good``.

    A line is one JSON object and nothing else. Numbers may be quoted; a line with a
    number that cannot be read is malformed. Further columns stay. A line is trimmed and
    parsed once, however many conditions look at what was found.
    """
    given = F.col(column)
    # Most lines have nothing to trim; the expression is tried at the start of a run of blanks only.
    edged = F.trim(given, F.lit(_EDGES)) != given
    text = F.when(edged, F.trim(F.regexp_replace(given, r"^\s+|(?<!\s)\s++$", ""))).otherwise(given)
    others = [c for c in lines.columns if c != column]
    filled = _once(lines, text, "line", others).filter(F.col("line") != "")
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in JOURNAL.fields])
    # As an array of one element, whatever follows the object makes the text malformed.
    parsed = F.from_json(F.concat(F.lit("["), "line", F.lit("]")), T.ArrayType(texts))
    single = F.when(F.size("entries") == 1, F.get("entries", F.lit(0)))
    readable = F.col("entry").isNotNull() & F.col("line").startswith("{")
    for f in JOURNAL.fields:
        if not isinstance(f.dataType, T.StringType):
            given = F.col("entry")[f.name]
            readable = readable & (given.isNull() | given.try_cast(f.dataType).isNotNull())
    return (
        _once(filled, parsed, "entries", [*others, "line"])
        .select(*others, "line", single.alias("entry"))
        .withColumn("good", F.coalesce(readable, F.lit(False)))
    )


def parse_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split JSON lines into journal rows and malformed lines; blank lines vanish."""
    judged = judged_lines(lines.select(column), column)
    found = [F.col("entry")[f.name].try_cast(f.dataType).alias(f.name) for f in JOURNAL.fields]
    return judged.filter("good").select(*found), judged.filter(~F.col("good")).select("line")


def entries(orders: DataFrame, now: Column | None = None) -> DataFrame:
    """Journal rows for placed orders ``symbol, side, qty, price, ...``.

    ``ts`` is the UTC time in whole seconds as ISO text.
    """
    at = F.current_timestamp() if now is None else now
    stamp = F.concat(F.date_format(utc_clock(at), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    have = set(orders.columns)
    note = F.coalesce("note", F.lit("")) if "note" in have else F.lit("")
    multiplier = F.col("multiplier") if "multiplier" in have else F.lit(1.0)
    return orders.select(
        stamp.alias("ts"),
        F.upper("symbol").alias("symbol"),
        "side",
        "qty",
        "price",
        multiplier.cast("double").alias("multiplier"),
        F.round(order_notional(F.col("qty"), F.col("price"), multiplier), 2).alias("notional"),
        "order_id",
        "account_last4",
        note.alias("note"),
    )


def order_day(ts: Column) -> Column:
    """UTC day of a journal timestamp text."""
    return F.substring(ts, 1, 10).try_cast("date")


def daily_order_count(journal: DataFrame) -> DataFrame:
    return (
        journal.groupBy(order_day(F.col("ts")).alias("day"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .filter(F.col("day").isNotNull())
    )


def orders_with_daily_count(orders: DataFrame, journal: DataFrame) -> DataFrame:
    """Add ``placed_today``: journaled orders on the day of each proposed order."""
    counts = daily_order_count(journal).withColumnRenamed("orders", "placed_today")
    return (
        orders.withColumn("day", order_day(F.col("ts")))
        .join(counts, "day", "left")
        .withColumn("placed_today", F.coalesce("placed_today", F.lit(0)))
    )


def sensible(value: Column) -> Column:
    """Whether a number is there and is one."""
    return value.isNotNull() & ~F.isnan(value)


def positive(value: Column) -> Column:
    return F.coalesce(sensible(value.cast("double")) & (value > 0), F.lit(False))


def violations(limits: Limits, placed_today: Column | None) -> Column:
    """Reasons to reject an order, all that apply; empty if it passes.

    A missing multiplier counts as 1; an order without a quantity, a price or a notional
    never passes. Without ``placed_today`` the daily cap is left to the caller.
    """
    multiplier = F.coalesce(F.col("multiplier"), F.lit(1.0))
    notional = order_notional(F.col("qty"), F.col("price"), multiplier)
    cap = F.lit(float(limits.max_notional))
    most = F.lit(limits.max_daily_orders)
    dollars = lambda c: F.format_number(c, 2)
    broken = F.array_compact(
        F.array(
            F.when(
                ~F.lit(limits.allow_live), F.lit("live orders are off: dry run")
            ),
            F.when(
                ~sensible(notional), F.lit("notional cannot be worked out")
            ),
            F.when(
                sensible(notional) & (notional > cap),
                F.format_string(
                    "notional $%s exceeds $%s (over by $%s)",
                    dollars(notional),
                    dollars(cap),
                    dollars(notional - cap),
                ),
            ),
            F.lit(None)
            if placed_today is None
            else F.when(
                placed_today >= most,
                F.format_string("already placed %d order(s) today; limit %d", placed_today, most),
            ),
        )
    )
    # An order that makes no sense is turned away before the rules are looked at.
    return (
        F.when(~positive(F.col("qty")), F.array(F.lit("quantity must be positive")))
        .when(~positive(F.col("price")), F.array(F.lit("price must be positive")))
        .otherwise(broken)
    )


def check_orders(orders: DataFrame, journal: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Verdict ``reasons, passed`` for every proposed order."""
    counted = orders_with_daily_count(orders, journal)
    return counted.withColumn("reasons", violations(limits, F.col("placed_today"))).withColumn(
        "passed", F.size("reasons") == 0
    )


def journal_today(journal: DataFrame, day: dt.date | Column | None = None) -> DataFrame:
    """Entries of one UTC day."""
    if day is None:
        day = F.to_date(utc_clock(F.current_timestamp()))
    return journal.filter(order_day(F.col("ts")) == (day if isinstance(day, Column) else F.lit(day)))


def day_total(journal: DataFrame, day: dt.date | Column | None = None) -> DataFrame:
    return journal_today(journal, day).agg(
        F.count(F.lit(1)).alias("orders"),
        F.coalesce(F.sum(F.col("notional").cast(MONEY)).cast("double"), F.lit(0.0)).alias("notional"),
    )


def journal_summary(journal: DataFrame) -> DataFrame:
    """Orders and amounts per symbol and, with symbol NULL, in total.

    Whatever is not a buy counts as sold. ``first_ts`` is the earliest entry.
    """
    amount = F.coalesce("notional", F.lit(0.0)).cast(MONEY)
    buy = F.coalesce(F.col("side") == "buy", F.lit(False))
    none = F.lit(0).cast(MONEY)
    bought = F.sum(F.when(buy, amount).otherwise(none))
    sold = F.sum(F.when(buy, none).otherwise(amount))
    named = journal.withColumn("symbol", F.coalesce("symbol", F.lit("?")))
    return named.rollup("symbol").agg(
        F.count(F.lit(1)).alias("orders"),
        bought.cast("double").alias("bought"),
        sold.cast("double").alias("sold"),
        (bought - sold).cast("double").alias("net"),
        F.min("ts").alias("first_ts"),
    )


def entry_time(ts: Column) -> Column:
    """Instant of a journal timestamp; texts without an offset are UTC."""
    return F.when(
        ts.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), ts.try_cast("timestamp")
    ).otherwise(from_utc(ts.try_cast("timestamp_ntz")))
