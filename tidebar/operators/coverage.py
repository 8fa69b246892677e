"""Keeping a bar table complete: what is covered, what is missing, what is newer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.markettime import from_utc, market_date
from tidebar.schemas import DEFAULT_EXCHANGES, EMBARGO_MINUTES, HISTORY_FLOOR


def upsert_bars(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """All bars of both tables; the new one wins where both have a bar."""
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new)


def coverage_of(bars: DataFrame) -> DataFrame:
    """Covered market dates and row count of each symbol of a bar table."""
    date = market_date(F.col("ts"))
    return bars.groupBy("symbol").agg(
        F.min(date).alias("cov_start"), F.max(date).alias("cov_end"), F.count(F.lit(1)).alias("rows")
    )


def coverage_gaps(requests: DataFrame, coverage: DataFrame) -> DataFrame:
    """Window still to be loaded per request ``symbol, start, end``.

    Nothing if the request lies inside the coverage; the missing side if it sticks
    out on one side; the whole request if nothing is covered, nothing overlaps, or it
    sticks out on both sides. Requests without a gap are left out.
    """
    start, end = F.col("start"), F.col("end")
    first, last = F.col("cov_start"), F.col("cov_end")
    whole = (
        first.isNull() | (end < first) | (start > last) | ((start < first) & (end > last))
    )
    early, late = start < first, end > last
    return (
        requests.join(coverage.select("symbol", "cov_start", "cov_end"), "symbol", "left")
        .filter(whole | early | late)
        .select(
            *[c for c in requests.columns if c not in ("start", "end")],
            F.when(whole | early, start).otherwise(F.date_add(last, 1)).alias("gap_start"),
            F.when(whole | late, end).otherwise(F.date_sub(first, 1)).alias("gap_end"),
        )
    )


def batch_by_window(gaps: DataFrame, batch_size: int = 10_000) -> DataFrame:
    """Symbols that miss the same window, as one request.

    A window that is missing for more than ``batch_size`` symbols becomes several
    requests of about that size, so no request grows with the universe.
    """
    keys = ["gap_start", "gap_end"]
    sizes = gaps.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / batch_size).cast("int").alias("parts")
    )
    part = F.pmod(F.xxhash64("symbol"), F.col("parts"))
    return (
        gaps.join(sizes, keys)
        .groupBy(*keys, part.alias("part"))
        .agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
        .drop("part")
    )


def merge_coverage(
    old: DataFrame, loaded: DataFrame, last_settled: Column | dt.date | None = None
) -> DataFrame:
    """Coverage after loading windows ``symbol, start, end``, any number per symbol.

    Touching or overlapping windows merge, with each other and with the old one. One span
    stays per symbol: the one that holds the old coverage if something new joined it, else
    the new one that ends last. The end of what was loaded is capped at the last settled
    market date; what is left empty is dropped.
    """
    settled = (
        F.date_sub(market_date(F.current_timestamp()), 1)
        if last_settled is None
        else (last_settled if isinstance(last_settled, Column) else F.lit(last_settled))
    )
    known = old.select(
        "symbol", F.col("cov_start").alias("start"), F.col("cov_end").alias("end"), F.lit(False).alias("new")
    )
    spans = loaded.select("symbol", "start", "end", F.lit(True).alias("new")).filter("start <= end")
    order = Window.partitionBy("symbol").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("start") > F.date_add(reach, 1), F.lit(True)).cast("int")
    islands = (
        known.unionByName(spans)
        .withColumn("apart", apart)
        .withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("symbol", "island")
        .agg(
            F.max("new").alias("fresh"),
            F.max(~F.col("new")).alias("held"),
            F.min("start").alias("cov_start"),
            F.max("end").alias("cov_end"),
        )
    )
    kept = islands.groupBy("symbol").agg(
        F.max(F.struct("fresh", "held", "cov_end", "cov_start")).alias("k")
    )
    end = F.when(F.col("k.fresh"), F.least("k.cov_end", settled)).otherwise(F.col("k.cov_end"))
    return kept.select("symbol", F.col("k.cov_start").alias("cov_start"), end.alias("cov_end")).filter(
        F.col("cov_end") >= F.col("cov_start")
    )


def _bound(text: Column, end_of_day: bool) -> Column:
    """Instant of a bound given as a date or a timestamp text; NULL if unreadable."""
    is_date = F.length(text) == 10
    day = text.try_cast("date").cast("timestamp_ntz")
    if end_of_day:
        day = day + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    moment = F.when(
        text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text.try_cast("timestamp")
    ).otherwise(from_utc(text.try_cast("timestamp_ntz")))
    return F.when(is_date, from_utc(day)).otherwise(moment)


def cap_recent(start: Column, end: Column, as_of: Column) -> Column:
    """``end`` moved back to the embargo, given bounds as text.

    NULL if that is not needed, because the end is older, or does not help, because
    the window starts inside the embargo.
    """
    cutoff = as_of - F.expr(f"INTERVAL {EMBARGO_MINUTES} MINUTES")
    last, first = _bound(end, True), _bound(start, False)
    pointless = F.coalesce(last <= cutoff, F.lit(False)) | F.coalesce(first >= cutoff, F.lit(False))
    return F.when(~pointless, cutoff)


def before_history_floor(start: Column, asset_class: Column | None = None) -> Column:
    """Whether a stock request starts before the vendor's history does."""
    early = start < F.lit(HISTORY_FLOOR).cast("date")
    return early if asset_class is None else early & (asset_class == "stocks")


def filter_universe(
    assets: DataFrame,
    exchanges: tuple[str, ...] = DEFAULT_EXCHANGES,
    tradable_only: bool = True,
    shortable_only: bool = False,
) -> DataFrame:
    wanted = F.upper("exchange").isin([e.upper() for e in exchanges])
    if tradable_only:
        wanted = wanted & F.col("tradable")
    if shortable_only:
        wanted = wanted & F.col("shortable")
    return assets.filter(wanted)
