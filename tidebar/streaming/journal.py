"""Order journals and order checks on streams."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebar.functions.markettime import utc_date
from tidebar.operators import journal as journal_ops
from tidebar.operators.journal import Limits


def journal_stream(lines: DataFrame, column: str = "value") -> DataFrame:
    """Journal rows of a stream of JSON lines with their time as ``at``."""
    rows, _ = journal_ops.parse_lines(lines, column)
    return rows.withColumn("at", journal_ops.entry_time(F.col("ts")))


def daily_counts(journal: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Orders per UTC day; a day is final when the watermark has passed it."""
    return (
        journal.withWatermark("at", lateness)
        .groupBy(F.window("at", "1 day").alias("span"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .select(utc_date(F.col("span.start")).alias("day"), "orders")
    )


# Reasons pass through Python as one text, empty if there are none: lists are much slower there.
_BETWEEN = "\x1f"
_VERDICTS = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("reasons", T.StringType()),
        T.StructField("passed", T.BooleanType()),
    ]
)
_CANDIDATES = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("lane", T.IntegerType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("reasons", T.StringType()),
    ]
)


class _FirstClear(StatefulProcessor):
    """Marks the first ``limit`` orders of a day and shard that break no rule.

    The state is how many there were, until the watermark has passed the end of the day. Rows
    come in order of time within a batch.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long")

    def mark(
        self, day: dt.date, rows: Iterator[pd.DataFrame]
    ) -> Iterator[tuple[pd.DataFrame, pd.Series]]:
        known = self.seen.exists()
        seen = self.seen.get()[0] if known else 0
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        frame = pd.concat(frames).sort_values(["at", "order_id"], kind="stable")
        frame = frame.reset_index(drop=True)
        clear = frame["reasons"] == ""
        yield frame, clear & (seen + clear.cumsum() <= self.limit)
        self.seen.update((min(seen + int(clear.sum()), self.limit),))
        if not known:
            over = dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc) + dt.timedelta(days=1)
            self.handle.registerTimer(int(over.timestamp()) * 1000)

    def with_cap(self, reasons: pd.Series, first: pd.Series) -> pd.Series:
        """Reasons with the cap for orders that break no other rule and come too late."""
        return reasons.mask((reasons == "") & ~first, _full(self.limit))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The day is over: no order of it can come any more, so its count goes."""
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Shortlist(_FirstClear):
    """Lane 0 for orders that may still pass, other lanes for the rest."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        day, shard = key
        for frame, first in self.mark(day, rows):
            out = frame[["at", "order_id", "symbol", "reasons"]].copy()
            out.insert(0, "day", day)
            out.insert(1, "lane", (~first).astype("int32") * (shard + 1))
            out["reasons"] = self.with_cap(frame["reasons"], first)
            yield out


class _DailyCap(_FirstClear):
    """Verdicts; what comes in with a reason leaves with it."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        day, _ = key
        for frame, first in self.mark(day, rows):
            reasons = self.with_cap(frame["reasons"], first)
            yield pd.DataFrame(
                {
                    "day": day,
                    "order_id": frame["order_id"],
                    "symbol": frame["symbol"],
                    "reasons": reasons,
                    "passed": first,
                }
            )


def _full(limit: int) -> str:
    return f"already placed {limit} order(s) today; limit {limit}"


def check_order_stream(
    orders: DataFrame, limits: Limits = Limits(), shards: int = 16, lateness: str = "2 days"
) -> DataFrame:
    """Verdicts for orders as they arrive; those that pass count against the day.

    ``orders`` has ``ts, order_id, symbol, qty, price, multiplier``. Needs the RocksDB
    state store. The cap is one count for everybody, yet a day is not one task: of the
    orders of a shard only the first ``max_daily_orders`` can be among the first ones
    of the day, so each shard sends on these few and turns away the rest itself.

    A day's counts are kept until the watermark, ``lateness`` behind the latest order, has passed
    its end. Orders older than the watermark get no verdict, so they don't pass; an order without
    a readable time has no day to count against and is turned away.
    """
    judged = orders.select(
        journal_ops.order_day(F.col("ts")).alias("day"),
        F.pmod(F.xxhash64("order_id"), F.lit(shards)).cast("int").alias("shard"),
        journal_ops.entry_time(F.col("ts")).alias("at"),
        "order_id",
        "symbol",
        F.array_join(journal_ops.violations(limits, None), _BETWEEN).alias("reasons"),
    ).withWatermark("at", lateness)
    dated = F.col("day").isNotNull() & F.col("at").isNotNull()
    shortlist = (
        judged.filter(dated)
        .groupBy("day", "shard")
        .transformWithStateInPandas(
            _Shortlist(limits.max_daily_orders),
            _CANDIDATES,
            "append",
            "eventTime",
            eventTimeColumnName="at",
        )
    )
    capped = shortlist.groupBy("day", "lane").transformWithStateInPandas(
        _DailyCap(limits.max_daily_orders), _VERDICTS, "append", "eventTime"
    )
    reasons = F.when(F.col("reasons") == "", F.array().cast("array<string>")).otherwise(
        F.split("reasons", _BETWEEN)
    )
    undated = judged.filter(~dated).select(
        "day",
        "order_id",
        "symbol",
        F.array_append(reasons, F.lit("the time of the order cannot be read")).alias("reasons"),
        F.lit(False).alias("passed"),
    )
    return capped.withColumn("reasons", reasons).unionByName(undated)
