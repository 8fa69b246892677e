"""Building, filtering and aligning bars."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.markettime import market_date, minute_of_day
from tidebar.functions.timeframe import SESSION_BOUNDS, TimeFrame, bucket_start, check_session
from tidebar.operators import scans
from tidebar.schemas import BAR_FIELDS, MARKET_TZ


# Bits of the integer types.
_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
_WIDE = "decimal(38,0)"


def tick_order(ticks: DataFrame, tiebreak: Sequence[str] = ()) -> Column:
    """What orders ticks: ``ts``, then the columns of ``tiebreak``, nulls first.

    Integers of together 64 bits are packed with the microseconds into one decimal, a primitive
    of the aggregation buffer, so that Spark aggregates in a hash map. Other columns
    become a struct, for which it sorts first.
    """
    bits = [_BITS.get(ticks.schema[c].dataType.simpleString()) for c in tiebreak]
    if not tiebreak:
        return F.col("ts")
    if None in bits or sum(bits) > 64 or len(bits) > 2:
        return F.struct("ts", *tiebreak)
    key = F.unix_micros("ts").cast(_WIDE)
    for name, width in zip(tiebreak, bits):
        # Numbers of that many bits and one place below them for null.
        stride = F.lit(Decimal(2 ** (width + 1))).cast("decimal(20,0)")
        low = F.lit(Decimal(-(2 ** (width - 1)) - 1)).cast("decimal(20,0)")
        key = (key * stride).cast(_WIDE) + F.coalesce(F.col(name).cast("decimal(20,0)"), low)
        key = key.cast(_WIDE)
    return key


def bar_aggregates(at: Column) -> list[Column]:
    """Open, high, low, close, volume, trade count and vwap of ticks in the order of ``at``."""
    return [
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("size").cast("double").alias("volume"),
        F.count(F.lit(1)).cast("double").alias("trade_count"),
        F.try_divide(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("vwap"),
    ]


def ticks_to_bars(
    ticks: DataFrame,
    timeframe: str | TimeFrame,
    tiebreak: Sequence[str] = (),
    tz: str = MARKET_TZ,
) -> DataFrame:
    """Bars from ticks ``symbol, ts, price, size``; days and longer follow ``tz``."""
    tf = TimeFrame.of(timeframe)
    start = bucket_start(F.col("ts"), tf, tz)
    return (
        ticks.filter(F.col("price") > 0)
        .groupBy("symbol", start.alias("bar_ts"))
        .agg(*bar_aggregates(tick_order(ticks, tiebreak)))
        .select("symbol", F.col("bar_ts").alias("ts"), *BAR_FIELDS)
    )


# -- filters -----------------------------------------------------------------


def _as_date(value: str | dt.date) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def between_dates(
    bars: DataFrame, start: str | dt.date, end: str | dt.date | None = None
) -> DataFrame:
    """Bars dated ``start`` to ``end`` in market time, both included.

    A generous bound on ``ts`` itself is added, because only that one reaches the
    parquet reader; the exact test on the market date follows.
    """
    first = _as_date(start)
    last = F.lit(_as_date(end)) if end is not None else market_date(F.current_timestamp())
    if end is not None and _as_date(end) < first:
        raise ValueError(f"end ({end}) is before start ({start})")
    out = bars.filter(F.col("ts") >= _instant(first - dt.timedelta(days=1)))
    if end is not None:
        out = out.filter(F.col("ts") < _instant(_as_date(end) + dt.timedelta(days=3)))
    return out.filter(market_date(F.col("ts")).between(F.lit(first), last))


def _instant(day: dt.date) -> Column:
    return F.lit(dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc))


def filter_session(
    bars: DataFrame,
    timeframe: str | TimeFrame,
    session: str = "regular",
    asset_class: str = "stocks",
) -> DataFrame:
    """Keep intraday bars whose span overlaps the session, in market time."""
    opens, closes = SESSION_BOUNDS[check_session(session)]
    tf = TimeFrame.of(timeframe, session)
    if not tf.is_intraday or asset_class == "crypto":
        return bars
    start = minute_of_day(F.col("ts"))
    return bars.filter((start < closes) & (start + tf.minutes > opens))


def head_until(bars: DataFrame, ts: dt.datetime | Column) -> DataFrame:
    return bars.filter(F.col("ts") <= (ts if isinstance(ts, Column) else F.lit(ts)))


def bar_at(bars: DataFrame, ts: dt.datetime | Column) -> DataFrame:
    return bars.filter(F.col("ts") == (ts if isinstance(ts, Column) else F.lit(ts)))


def drop_sparse_symbols(bars: DataFrame, min_coverage: float = 0.9) -> DataFrame:
    """Keep symbols with a close on at least this share of the timeline."""
    total = bars.agg(F.count_distinct("ts")).scalar()
    keep = (
        bars.groupBy("symbol")
        .agg(F.count("close").alias("n"))
        .filter(F.col("n") / total >= min_coverage)
        .select("symbol")
    )
    return bars.join(keep, "symbol", "left_semi")


def settled_only(bars: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Bars dated yesterday or earlier in market time."""
    today = market_date(F.current_timestamp() if as_of is None else as_of)
    return bars.filter(market_date(F.col("ts")) < today)


def field(bars: DataFrame, name: str) -> DataFrame:
    """One bar field in long form; pivot it only for output."""
    if name not in BAR_FIELDS:
        raise KeyError(f"{name!r} is not one of {BAR_FIELDS}")
    return bars.select("symbol", "ts", F.col(name).alias(name))


def keep_symbols(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    return bars.join(symbols.select("symbol"), "symbol", "left_semi")


def unknown_symbols(targets: DataFrame, bars: DataFrame) -> DataFrame:
    """Targeted symbols that have no bars."""
    return (
        targets.select("symbol").distinct().join(bars.select("symbol"), "symbol", "left_anti")
    )


def require_known_symbols(targets: DataFrame, bars: DataFrame) -> DataFrame:
    missing = [r.symbol for r in unknown_symbols(targets, bars).limit(20).collect()]
    if missing:
        raise KeyError(f"symbols without bars: {sorted(missing)}")
    return targets


def require_rows(bars: DataFrame, what: str) -> DataFrame:
    if bars.isEmpty():
        raise ValueError(f"no bars for {what}: check symbols, dates and feed")
    return bars


def require_timeline(bars: DataFrame, length: int = 2) -> DataFrame:
    found = bars.select("ts").distinct().limit(length).count()
    if found < length:
        raise ValueError(f"need at least {length} bars, got {found}")
    return bars


# -- summaries and alignment ---------------------------------------------------


def panel_summary(bars: DataFrame) -> DataFrame:
    return bars.agg(
        F.count_distinct("symbol").alias("symbols"),
        F.count_distinct("ts").alias("bars"),
        F.min(market_date(F.col("ts"))).alias("first_date"),
        F.max(market_date(F.col("ts"))).alias("last_date"),
    )


def symbols_of(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()


def with_seq(bars: DataFrame, line: DataFrame | None = None) -> DataFrame:
    """Add ``seq``, the place of a bar on the common timeline."""
    return bars.join(scans.timeline(bars) if line is None else line, "ts")


def dense_grid(
    bars: DataFrame,
    chunk_rows: int = 65_536,
    fields: Sequence[str] = ("open", "close"),
    line: DataFrame | None = None,
) -> DataFrame:
    """One row per symbol and timestamp, gaps NULL, with carried prices.

    Every row fills the gap after it, so no symbol-by-timestamp product is joined.
    Symbols are handled chunk by chunk; the last known close enters a chunk as an
    extra leading row. Besides ``fields`` the result has

    * ``mark`` - last known close up to this bar,
    * ``prev_mark`` - last known close before this bar.
    """
    line = scans.timeline(bars) if line is None else line
    length = line.agg(F.max("seq") + 1).scalar()
    names = list(dict.fromkeys(["close", *fields]))
    rows = bars.join(line, "ts").select(
        "symbol",
        "seq",
        F.floor(F.col("seq") / chunk_rows).alias("chunk"),
        F.lit(True).alias("is_bar"),
        F.col("close").alias("known"),
        *names,
    )
    closes = rows.groupBy("symbol", "chunk").agg(
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("seq"))).alias("last_close")
    )
    earlier = (
        Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    heads = (
        symbols_of(bars)
        .select(
            "symbol",
            F.explode(F.sequence(F.lit(0), F.floor((length - 1) / chunk_rows))).alias("chunk"),
        )
        .join(closes, ["symbol", "chunk"], "left")
        .select(
            "symbol",
            (F.col("chunk") * chunk_rows).alias("seq"),
            "chunk",
            F.lit(False).alias("is_bar"),
            F.last("last_close", ignorenulls=True).over(earlier).alias("known"),
        )
    )
    w = Window.partitionBy("symbol", "chunk").orderBy("seq", "is_bar")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.least((F.col("chunk") + 1) * chunk_rows, length)
    spans = (
        rows.unionByName(heads, allowMissingColumns=True)
        .withColumn("mark", F.last("known", ignorenulls=True).over(upto))
        .withColumns(
            {
                "before": F.lag("mark").over(w),
                "until": F.coalesce(F.lead("seq").over(w), stop),
            }
        )
        .filter(F.col("until") > F.col("seq"))
    )
    first = F.col("pos") == F.col("seq")
    cells = spans.select(
        "*", F.explode(F.sequence(F.col("seq"), F.col("until") - 1)).alias("pos")
    ).select(
        "symbol",
        F.col("pos").alias("seq"),
        *[F.when(first, F.col(c)).alias(c) for c in fields],
        "mark",
        F.when(first & F.col("is_bar"), F.col("before")).otherwise(F.col("mark")).alias(
            "prev_mark"
        ),
    )
    return cells.join(line, "seq").select(
        "symbol", "ts", "seq", *fields, "mark", "prev_mark"
    )


def effective_open(grid: DataFrame) -> DataFrame:
    """Price at which a symbol trades on each bar, and whether it can trade.

    The open, or the last known close where there is no open. A symbol that never
    had a price, or has none above zero, is not traded.
    """
    price = F.coalesce("open", "prev_mark")
    return grid.withColumns(
        {"trade_price": price, "tradable": F.coalesce(price > 0, F.lit(False))}
    )


def next_bar_open(decisions: DataFrame, bars: DataFrame) -> DataFrame:
    """Pair each decision ``run_id, ts, symbol`` with the open of the next bar.

    Decisions on the last bar have none and are left out.
    """
    line = scans.timeline(bars)
    nxt = line.select((F.col("seq") - 1).alias("seq"), F.col("ts").alias("exec_ts"))
    opens = bars.select("symbol", F.col("ts").alias("exec_ts"), F.col("open").alias("exec_open"))
    return (
        decisions.join(line, "ts")
        .join(nxt, "seq")
        .join(opens, ["symbol", "exec_ts"], "left")
        .drop("seq")
    )


def session_counts(
    bars: DataFrame, calendar: DataFrame, timeframe: str | TimeFrame = "1Day"
) -> DataFrame:
    """Bars per symbol-independent session against the calendar.

    ``calendar`` has ``date, open, close`` with times as ``HH:MM``. ``expected`` is
    the number of bars that fit the session, ``is_half_day`` marks early closes.
    """
    tf = TimeFrame.of(timeframe)
    found = bars.groupBy(market_date(F.col("ts")).alias("date")).agg(
        F.count_distinct("ts").alias("bars")
    )
    clock = lambda c: (
        F.split(c, ":")[0].cast("int") * 60 + F.split(c, ":")[1].cast("int")
    )
    opens, closes = clock(F.col("open")), clock(F.col("close"))
    if tf.is_intraday:
        expected = F.ceil(closes / tf.minutes) - F.floor(opens / tf.minutes)
    else:
        expected = F.lit(1)
    return (
        calendar.withColumn("date", F.to_date("date"))
        .join(found, "date", "left")
        .select(
            "date",
            F.coalesce("bars", F.lit(0)).cast("long").alias("bars"),
            expected.cast("long").alias("expected"),
            (closes < SESSION_BOUNDS["regular"][1]).alias("is_half_day"),
        )
    )
