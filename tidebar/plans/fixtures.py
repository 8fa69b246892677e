"""Market tables derived from the given ones.

The given tables hold no bars: events serve as ticks, order lines as trades of a
brand, orders as proposed orders, suppliers as the asset universe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.markettime import from_utc, market_date, utc_clock
from tidebar.operators import bars as bar_ops
from tidebar.operators.coverage import coverage_of
from tidebar.session import durable

# Order of trades within a day; unique together with the ship date.
TRADE_ORDER = [
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
    "size",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_ticks(events: DataFrame) -> DataFrame:
    return events.filter(F.col("value") > 0).select(
        F.col("event_type").alias("symbol"),
        from_utc(F.col("ts")).alias("ts"),
        F.col("value").alias("price"),
        (1 + F.col("user_id") % 10).alias("size"),
        "event_id",
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ticks(table(spark, sf_dir, "events"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.ticks_to_bars(ticks(spark, sf_dir), "1Hour", ["event_id"])


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.ticks_to_bars(ticks(spark, sf_dir), "1Day", ["event_id"])


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("symbol"),
        from_utc(F.col("l_shipdate")).alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_returnflag",
        "p_type",
    )


def made_brand_bars(spark: SparkSession, sf_dir: str, timeframe: str) -> DataFrame:
    return bar_ops.ticks_to_bars(trades(spark, sf_dir), timeframe, TRADE_ORDER, tz="UTC")


def brand_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars as a stored table, which is what operators on bars start from."""
    return durable(made_brand_bars(spark, sf_dir, "1Day"))


def brand_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return durable(made_brand_bars(spark, sf_dir, "1Month"))


def calm(bars: DataFrame) -> DataFrame:
    """Prices drawn together, so that an account that holds them stays solvent."""
    return bars.select(
        "symbol",
        "ts",
        *[(100 * F.pow(f, F.lit(0.02))).alias(f) for f in ("open", "high", "low", "close")],
    )


def benchmark_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(from_utc(F.col("o_orderdate")).alias("ts")).agg(
        F.avg("o_totalprice").alias("close")
    )


def iso(ts: Column) -> Column:
    return F.concat(F.date_format(utc_clock(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as journal entries; promotional parts count as contracts of 100."""
    t = trades(spark, sf_dir)
    multiplier = F.when(F.col("p_type") == "PROMO", 100.0).otherwise(1.0)
    return t.select(
        iso(F.col("ts")).alias("ts"),
        "symbol",
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("size").alias("qty"),
        "price",
        multiplier.alias("multiplier"),
        F.round(F.col("size") * F.col("price") * multiplier, 2).alias("notional"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("order_id"),
        F.lpad((F.col("l_suppkey") % 10000).cast("string"), 4, "0").alias("account_last4"),
        F.lit("").alias("note"),
    )


def proposed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        iso(from_utc(F.col("o_orderdate"))).alias("ts"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_orderpriority").alias("symbol"),
        F.lit("buy").alias("side"),
        F.lit(1.0).alias("qty"),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("multiplier"),
        F.col("o_totalprice").alias("notional"),
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (table(spark, sf_dir, n) for n in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_name").alias("symbol"),
            F.col("r_name").alias("exchange"),
            (F.col("s_acctbal") >= 0).alias("tradable"),
            (F.col("s_acctbal") >= 5000).alias("shortable"),
        )
    )


def calendar(bars: DataFrame) -> DataFrame:
    """Weekdays spanned by the bars; the 15th of a month is a half day."""
    spans = bar_ops.panel_summary(bars)
    days = spans.select(
        F.explode(F.sequence("first_date", "last_date")).alias("date")
    ).filter(F.weekday("date") < 5)
    half = F.dayofmonth("date") == 15
    return days.select(
        "date",
        F.lit("09:30").alias("open"),
        F.when(half, "13:00").otherwise("16:00").alias("close"),
    )


def requests(bars: DataFrame) -> DataFrame:
    """Three requests per symbol: all dates, the first half, and after the end."""
    spans = coverage_of(bars)
    middle = F.expr("date_add(cov_start, cast(floor(datediff(cov_end, cov_start) / 2) as int))")
    first, last = F.col("cov_start"), F.col("cov_end")

    def kind(name: str, start: Column, end: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), start.alias("start"), end.alias("end"))

    kinds = F.array(
        kind("all", first, last),
        kind("half", first, middle),
        kind("later", F.date_add(last, 10), F.date_add(last, 20)),
        kind("inside", F.date_add(first, 5), F.date_sub(middle, 5)),
    )
    return spans.select("symbol", F.explode(kinds).alias("k")).select("symbol", "k.*")


def first_half(bars: DataFrame) -> DataFrame:
    """Coverage that ends half-way through the dates of each symbol."""
    middle = F.expr("date_add(cov_start, cast(floor(datediff(cov_end, cov_start) / 2) as int))")
    return coverage_of(bars).select(
        "symbol", "cov_start", middle.alias("cov_end"), "rows"
    )


def payload_pages(bars: DataFrame) -> DataFrame:
    """Bars folded back into payload texts, one page per ET day."""
    item = F.struct(
        iso(F.col("ts")).alias("t"),
        F.col("open").alias("o"),
        F.col("high").alias("h"),
        F.col("low").alias("l"),
        F.col("close").alias("c"),
        F.col("volume").alias("v"),
        F.when(F.hour(utc_clock(F.col("ts"))) % 2 == 0, F.col("trade_count")).alias("n"),
        F.lit("x").alias("unused"),
    )
    lists = bars.groupBy(market_date(F.col("ts")).alias("day"), "symbol").agg(
        F.collect_list(item).alias("list")
    )
    return lists.groupBy("day").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("symbol", "list")))).alias("value")
    )
