"""Column layouts shared by every operator.

All prices and amounts are doubles; a missing value is NULL, never NaN.
Timestamps are instants (``TIMESTAMP``); market time is derived when needed.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the bar fields, in output order.
BAR_FIELDS = ["open", "high", "low", "close", "volume", "trade_count", "vwap"]

# The short names used in vendor payloads.
PAYLOAD_NAMES = {
    "o": "open",
    "h": "high",
    "l": "low",
    "c": "close",
    "v": "volume",
    "n": "trade_count",
    "vw": "vwap",
}

# Market conventions.
MARKET_TZ = "America/New_York"
HISTORY_FLOOR = "2016-01-04"
EMBARGO_MINUTES = 16
DEFAULT_EXCHANGES = ("NASDAQ", "NYSE", "ARCA")


def _doubles(names):
    return [T.StructField(n, T.DoubleType()) for n in names]


BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType())]
    + _doubles(BAR_FIELDS)
)

PAYLOAD_BAR = T.StructType(
    [T.StructField("t", T.StringType())] + _doubles(PAYLOAD_NAMES)
)
PAYLOAD = T.MapType(T.StringType(), T.ArrayType(PAYLOAD_BAR))
PAGED_PAYLOAD = T.StructType(
    [
        T.StructField("bars", PAYLOAD),
        T.StructField("next_page_token", T.StringType()),
    ]
)

JOURNAL = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("qty", T.DoubleType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("multiplier", T.DoubleType()),
        T.StructField("notional", T.DoubleType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("account_last4", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)

CALENDAR = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("open", T.StringType()),
        T.StructField("close", T.StringType()),
        T.StructField("session_open", T.StringType()),
        T.StructField("session_close", T.StringType()),
    ]
)

UNIVERSE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("tradable", T.BooleanType()),
        T.StructField("shortable", T.BooleanType()),
    ]
)

COVERAGE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("cov_start", T.DateType()),
        T.StructField("cov_end", T.DateType()),
        T.StructField("rows", T.LongType()),
        T.StructField("written_at", T.TimestampType()),
    ]
)

FILLS = [
    "run_id",
    "ts",
    "symbol",
    "side",
    "shares",
    "price",
    "reference_price",
    "notional",
    "commission",
    "slippage_cost",
]
