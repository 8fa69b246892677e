"""Vendor payloads: nested JSON pages of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.markettime import from_utc
from tidebar.schemas import BAR_FIELDS, PAGED_PAYLOAD, PAYLOAD, PAYLOAD_NAMES


def _flatten(parsed: DataFrame, bars: str) -> DataFrame:
    listed = parsed.select(F.explode(bars).alias("symbol", "list"))
    rows = listed.select("symbol", F.inline("list"))
    zoned = F.col("t").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    stamp = F.when(zoned, F.col("t").cast("timestamp")).otherwise(
        from_utc(F.col("t").cast("timestamp_ntz"))
    )
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    fields = {long: number(short).alias(long) for short, long in PAYLOAD_NAMES.items()}
    return rows.select("symbol", stamp.alias("ts"), *[fields[n] for n in BAR_FIELDS])


def decode_payload(pages: DataFrame, column: str = "value") -> DataFrame:
    """Bars of payload texts ``{symbol: [{t, o, h, l, c, v, n, vw}]}``.

    Unknown keys are ignored, absent fields are NULL.
    """
    return _flatten(pages.select(F.from_json(column, PAYLOAD).alias("bars")), "bars")


def decode_pages(pages: DataFrame, column: str = "value") -> DataFrame:
    """Bars of paged responses ``{"bars": {...} or null, "next_page_token": ...}``."""
    parsed = pages.select(F.from_json(column, PAGED_PAYLOAD).alias("page"))
    return _flatten(parsed.select("page.bars"), "bars")


def read_bar_payload(spark: SparkSession, path: str) -> DataFrame:
    """Bars of payload files, one JSON document per file.

    A vendor page holds at most 10,000 bars, so a whole file is a small row.
    """
    return decode_payload(spark.read.text(path, wholetext=True))


def stitch_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Bars of all pages of one or more paged downloads."""
    return decode_pages(spark.read.text(paths, wholetext=True))
