"""Queries that run the streaming operators over whole tables until drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import bars
from tidebar.operators.journal import Limits
from tidebar.plans import fixtures as fx
from tidebar.plans.registry import query, shown
from tidebar.plans.sql import et, rnd, with_tables
from tidebar.session import scratch_folder
from tidebar.sources.store import BarStore
from tidebar.streaming import bars as stream_bars
from tidebar.streaming import journal as stream_journal

_PLAIN = ("open", "high", "low", "close", "volume", "trade_count")
_BARS = "symbol, ts, open, high, low, close, volume, trade_count, " + rnd("vwap")
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _event_stream(spark, sf):
    """The event table as a stream of its files."""
    schema = fx.table(spark, sf, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return fx.as_ticks(files)


def _drain(stream, spark, name):
    """Run a stream to the end of its input and read what it wrote."""
    out = scratch_folder(spark, name)
    job = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", scratch_folder(spark, f"{name}-state"))
        .option("path", out)
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_SETTLED = "ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE value > 0) - INTERVAL 10 MINUTE"


@query(with_tables(f"SELECT {_BARS} FROM hourly WHERE {_SETTLED}"))
def streamed_hourly_bars(spark, sf):
    made = stream_bars.stream_bars(_event_stream(spark, sf), "1Hour", "10 minutes", ["event_id"])
    return shown(_drain(made, spark, "bars"), plain=_PLAIN)


_MINUTE = f"(hour({et('ts')}) * 60 + minute({et('ts')}))"


@query(
    with_tables(
        f"SELECT {_BARS} FROM hourly WHERE {_SETTLED} AND {_MINUTE} < 960 AND {_MINUTE} + 60 > 570"
    ).replace("SELECT symbol, ts, open", "SELECT upper(symbol) AS symbol, ts, open", 1)
)
def streamed_session_bars(spark, sf):
    """Symbols normalised on the way in, sessions filtered on the way out."""
    ticks = stream_bars.normalised(
        _event_stream(spark, sf).withColumn("symbol", F.concat(F.lit(" "), "symbol"))
    )
    made = bars.filter_session(stream_bars.stream_bars(ticks, "1Hour", tiebreak=["event_id"]), "1Hour")
    return shown(_drain(made, spark, "session"), plain=_PLAIN)


@query(with_tables(f"SELECT {_BARS} FROM hourly WHERE {_SETTLED}"))
def streamed_bar_store(spark, sf):
    """Settled bars merged into a bar table, each batch written twice."""
    made = stream_bars.stream_bars(_event_stream(spark, sf), "1Hour", "10 minutes", ["event_id"])
    store = BarStore(spark, scratch_folder(spark, "store"))
    write = stream_bars.upsert_into(store, "1Hour")

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    job = (
        made.writeStream.outputMode("append")
        .option("checkpointLocation", scratch_folder(spark, "store-state"))
        .foreachBatch(twice)
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return shown(store.read("1Hour"), plain=_PLAIN)


def _journal_stream(spark, sf):
    schema = fx.table(spark, sf, "orders").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    entry = F.struct(
        fx.iso(fx.from_utc(F.col("o_orderdate"))).alias("ts"),
        F.col("o_orderpriority").alias("symbol"),
        F.lit("buy").alias("side"),
        F.lit(1.0).alias("qty"),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("multiplier"),
        F.col("o_totalprice").alias("notional"),
        F.col("o_orderkey").cast("string").alias("order_id"),
    )
    return stream_journal.journal_stream(files.select(F.to_json(entry).alias("value")))


@query(
    with_tables(
        "SELECT day, count(*) AS orders FROM proposed "
        "WHERE day + INTERVAL 1 DAY <= (SELECT max(day) FROM proposed) - INTERVAL 1 HOUR GROUP BY day"
    )
)
def streamed_daily_counts(spark, sf):
    return _drain(stream_journal.daily_counts(_journal_stream(spark, sf)), spark, "counts")


@query(
    with_tables(
        "SELECT order_id, symbol, day, notional <= 250000 AND clear <= 4 AS passed FROM ("
        "SELECT *, sum(CASE WHEN notional <= 250000 THEN 1 ELSE 0 END) OVER "
        "(PARTITION BY day ORDER BY order_id ROWS UNBOUNDED PRECEDING) AS clear FROM proposed)"
    )
)
def streamed_order_checks(spark, sf):
    """Orders let through up to four a day, as they arrive in one batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    limits = Limits(max_notional=250_000.0, max_daily_orders=4, allow_live=True)
    checked = stream_journal.check_order_stream(_journal_stream(spark, sf), limits, shards=2)
    out = _drain(checked, spark, "checks")
    return out.select("order_id", "symbol", "day", "passed")


@query(with_tables(f"SELECT {_BARS} FROM hourly WHERE day(ts) <= 9 OR day(ts) > 12"))
def streamed_bar_store_batches(spark, sf):
    """Several batches into a bar table: days apart, then a late correction."""
    made = fx.hourly_bars(spark, sf)
    store = BarStore(spark, scratch_folder(spark, "store"))
    write = stream_bars.upsert_into(store, "1Hour")
    day = F.dayofmonth("ts")
    wrong = made.withColumn("close", F.lit(1.0))
    batches = [made.filter(day < 5), wrong.filter(day.between(5, 9)), made.filter(day > 12),
               made.filter(day.between(5, 9))]
    for number, batch in enumerate(batches):
        write(batch, number)
    return shown(store.read("1Hour"), plain=_PLAIN)
