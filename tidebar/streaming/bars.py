"""Bars from a stream of ticks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidebar.functions.markettime import market_date
from tidebar.functions.timeframe import TimeFrame
from tidebar.operators.bars import bar_aggregates, tick_order
from tidebar.schemas import BAR_FIELDS
from tidebar.sources.store import BarStore


def stream_bars(
    ticks: DataFrame,
    timeframe: str | TimeFrame,
    lateness: str = "10 minutes",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Bars of a tick stream, in append mode only once they are settled.

    A bar is emitted when the watermark has passed its end, so a forming bar never
    leaves the operator; ticks later than ``lateness`` are dropped. Only intraday
    bars have a fixed length and can be windows; roll days up from the stored ones.
    """
    tf = TimeFrame.of(timeframe)
    if not tf.is_intraday:
        raise ValueError(f"a stream needs intraday bars, got {tf.label}")
    return (
        ticks.filter(F.col("price") > 0)
        .withWatermark("ts", lateness)
        .groupBy("symbol", F.window("ts", f"{tf.minutes} minutes").alias("span"))
        .agg(*bar_aggregates(tick_order(ticks, tiebreak)))
        .select("symbol", F.col("span.start").alias("ts"), *BAR_FIELDS)
    )


def normalised(stream: DataFrame) -> DataFrame:
    """Trimmed upper-case symbols; rows without one are dropped."""
    symbol = F.upper(F.trim("symbol"))
    return stream.withColumn("symbol", symbol).filter(F.col("symbol") != "")


def upsert_into(store: BarStore, timeframe: str | TimeFrame) -> Callable[[DataFrame, int], None]:
    """Batch function that merges bars into a store, newest wins.

    A stream has no gaps of its own, so a batch covers what lies between the coverage so far
    and its bars: a weekend or a late correction never moves the end back. Writing the same batch again changes nothing, so a restarted query is safe.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        date = market_date(F.col("ts"))
        spans = batch.groupBy("symbol").agg(F.min(date).alias("first"), F.max(date).alias("last"))
        windows = spans.join(store.read_coverage(timeframe), "symbol", "left").select(
            "symbol",
            F.least("first", F.date_add("cov_end", 1)).alias("start"),
            F.greatest("last", F.date_sub("cov_start", 1)).alias("end"),
        )
        store.load(timeframe, batch, windows)

    return write


def start_upserts(
    bars: DataFrame, store: BarStore, timeframe: str | TimeFrame, checkpoint: str
) -> DataStreamWriter:
    return (
        bars.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(upsert_into(store, timeframe))
    )
