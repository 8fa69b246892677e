"""Queries on building, filtering, aligning and storing bars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.functions import markettime, timeframe, trading
from tidebar.operators import bars, coverage, indicators, scans
from tidebar.plans import fixtures as fx
from tidebar.plans.registry import query, shown
from tidebar.plans.sql import et, rnd, with_tables
from tidebar.schemas import BAR_FIELDS
from tidebar.session import scratch_folder
from tidebar.sources import payload, records, tables
from tidebar.sources.loading import load_bars
from tidebar.sources.store import BarStore

_BARS = "symbol, ts, open, high, low, close, volume, trade_count, " + rnd("vwap")
_PLAIN = ("open", "high", "low", "close", "volume", "trade_count")
_MORNING = dt.datetime(2024, 1, 10, 15, tzinfo=dt.timezone.utc)


@query(with_tables(f"SELECT {_BARS} FROM hourly"))
def hourly_bars(spark, sf):
    return shown(fx.hourly_bars(spark, sf), plain=_PLAIN)


@query(
    with_tables(
        f"SELECT {_BARS} FROM quarters",
        quarters="""
        SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS ts,
          arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
          arg_max(price, ts) AS close, sum(size)::DOUBLE AS volume,
          count(*)::DOUBLE AS trade_count, sum(price * size) / sum(size) AS vwap
        FROM ticks GROUP BY 1, 2""",
    )
)
def quarter_hour_bars(spark, sf):
    return shown(bars.ticks_to_bars(fx.ticks(spark, sf), "15Min"), plain=_PLAIN)


@query(
    with_tables(
        f"SELECT {_BARS} FROM tied",
        tied="""
        SELECT symbol, date_trunc('hour', ts) AS ts,
          first(price ORDER BY date_trunc('minute', ts), event_id DESC) AS open, max(price) AS high,
          min(price) AS low, last(price ORDER BY date_trunc('minute', ts), event_id DESC) AS close,
          sum(size)::DOUBLE AS volume, count(*)::DOUBLE AS trade_count,
          sum(price * size) / sum(size) AS vwap
        FROM ticks GROUP BY symbol, date_trunc('hour', ts)""",
    )
)
def bars_of_tied_ticks(spark, sf):
    """Ticks known to the minute only, the later numbered first."""
    ticks = fx.ticks(spark, sf).withColumns({"ts": F.date_trunc("minute", "ts"), "place": -F.col("event_id")})
    return shown(bars.ticks_to_bars(ticks, "1Hour", ["place"]), plain=_PLAIN)


@query(with_tables(f"SELECT {_BARS} FROM daily"))
def market_day_bars(spark, sf):
    return shown(fx.daily_bars(spark, sf), plain=_PLAIN)


@query(with_tables(f"SELECT {_BARS} FROM days"))
def brand_day_bars(spark, sf):
    return shown(fx.made_brand_bars(spark, sf, "1Day"), plain=_PLAIN)


@query(with_tables(f"SELECT {_BARS} FROM months"))
def brand_month_bars(spark, sf):
    return shown(fx.made_brand_bars(spark, sf, "1Month"), plain=_PLAIN)


_PAYLOAD_SQL = with_tables(
    "SELECT symbol, ts, open, high, low, close, volume, "
    "CASE WHEN hour(ts) % 2 = 0 THEN trade_count END AS trade_count, "
    "NULL::DOUBLE AS vwap FROM hourly"
)


@query(_PAYLOAD_SQL)
def payload_bars(spark, sf):
    pages = fx.payload_pages(fx.hourly_bars(spark, sf))
    return shown(payload.decode_payload(pages), plain=_PLAIN)


@query(_PAYLOAD_SQL)
def paged_payload_files(spark, sf):
    pages = fx.payload_pages(fx.hourly_bars(spark, sf)).select(
        F.concat(
            F.lit('{"bars": '), F.col("value"), F.lit(', "next_page_token": "more"}')
        ).alias("value")
    )
    ends = pages.limit(1).select(F.lit('{"bars": null, "next_page_token": null}').alias("value"))
    folder = scratch_folder(spark, "pages")
    # One page per file, as a download leaves them.
    pages.unionByName(ends).write.option("maxRecordsPerFile", 1).text(folder)
    return shown(payload.stitch_pages(spark, folder), plain=_PLAIN)


@query(
    with_tables(
        f"SELECT {_BARS} FROM hourly WHERE CAST({et('ts')} AS DATE) "
        "BETWEEN DATE '2024-01-05' AND DATE '2024-01-11'"
    )
)
def bars_between_dates(spark, sf):
    kept = bars.between_dates(fx.hourly_bars(spark, sf), "2024-01-05", "2024-01-11")
    return shown(kept, plain=_PLAIN)


def _session_sql(opens: int, closes: int) -> str:
    minute = f"(hour({et('ts')}) * 60 + minute({et('ts')}))"
    return with_tables(
        f"SELECT {_BARS} FROM hourly WHERE {minute} < {closes} AND {minute} + 60 > {opens}"
    )


@query(_session_sql(570, 960))
def regular_session_bars(spark, sf):
    return shown(bars.filter_session(fx.hourly_bars(spark, sf), "1Hour", "regular"), plain=_PLAIN)


@query(_session_sql(240, 1200))
def extended_session_bars(spark, sf):
    return shown(bars.filter_session(fx.hourly_bars(spark, sf), "1Hour", "extended"), plain=_PLAIN)


@query(with_tables(f"SELECT {_BARS} FROM hourly WHERE ts <= TIMESTAMP '2024-01-10 15:00:00'"))
def bars_until(spark, sf):
    return shown(bars.head_until(fx.hourly_bars(spark, sf), _MORNING), plain=_PLAIN)


@query(with_tables(f"SELECT {_BARS} FROM hourly WHERE ts = TIMESTAMP '2024-01-10 15:00:00'"))
def bars_at(spark, sf):
    return shown(bars.bar_at(fx.hourly_bars(spark, sf), _MORNING), plain=_PLAIN)


@query(
    with_tables(
        f"SELECT {_BARS} FROM days WHERE symbol IN (SELECT symbol FROM days GROUP BY symbol "
        "HAVING count(close) >= 0.6 * (SELECT count(DISTINCT ts) FROM days))"
    )
)
def well_covered_symbols(spark, sf):
    return shown(bars.drop_sparse_symbols(fx.brand_days(spark, sf), 0.6), plain=_PLAIN)


@query(with_tables(f"SELECT {_BARS} FROM hourly WHERE CAST({et('ts')} AS DATE) < DATE '2024-01-20'"))
def settled_bars(spark, sf):
    as_of = F.lit(dt.datetime(2024, 1, 20, 15, tzinfo=dt.timezone.utc))
    return shown(bars.settled_only(fx.hourly_bars(spark, sf), as_of), plain=_PLAIN)


@query(with_tables("SELECT symbol, ts, close FROM hourly"))
def close_field(spark, sf):
    return shown(bars.field(fx.hourly_bars(spark, sf), "close"), plain=_PLAIN)


@query(
    with_tables(
        "SELECT count(DISTINCT symbol) AS symbols, count(DISTINCT ts) AS bars, "
        f"min(CAST({et('ts')} AS DATE)) AS first_date, max(CAST({et('ts')} AS DATE)) AS last_date "
        "FROM hourly"
    )
)
def panel_summary(spark, sf):
    return bars.panel_summary(fx.hourly_bars(spark, sf))


@query(with_tables("SELECT DISTINCT symbol FROM days"))
def distinct_symbols(spark, sf):
    return bars.symbols_of(fx.brand_days(spark, sf))


@query(with_tables("SELECT ts, seq FROM day_line"))
def day_timeline(spark, sf):
    return shown(scans.timeline(fx.brand_days(spark, sf), chunk_seconds=200 * 86400))


@query(with_tables(f"SELECT {_BARS} FROM hourly ORDER BY ts, symbol"))
def ordered_bars(spark, sf):
    return shown(fx.hourly_bars(spark, sf).orderBy("ts", "symbol"), plain=_PLAIN)


@query(with_tables("SELECT symbol, ts, seq, open, close, mark, prev_mark FROM day_cells"))
def dense_day_grid(spark, sf):
    grid = bars.dense_grid(fx.brand_days(spark, sf), chunk_rows=500)
    return shown(grid, plain=("open", "close", "mark", "prev_mark"))


@query(
    with_tables(
        "SELECT symbol, ts, coalesce(open, prev_mark) AS trade_price, "
        "coalesce(coalesce(open, prev_mark) > 0, false) AS tradable FROM hour_cells"
    )
)
def tradable_prices(spark, sf):
    grid = bars.dense_grid(fx.hourly_bars(spark, sf), fields=("open",), chunk_rows=128)
    return shown(
        bars.effective_open(grid).select("symbol", "ts", "trade_price", "tradable"),
        plain=("trade_price",),
    )


@query(
    with_tables(
        "SELECT c.symbol AS run_id, c.symbol, c.ts, n.ts AS exec_ts, o.open AS exec_open "
        "FROM hour_panel c JOIN hour_line n ON n.seq = c.seq + 1 "
        "LEFT JOIN hourly o ON o.symbol = c.symbol AND o.ts = n.ts"
    )
)
def next_bar_opens(spark, sf):
    hourly = fx.hourly_bars(spark, sf)
    decisions = hourly.select(F.col("symbol").alias("run_id"), "ts", "symbol")
    out = bars.next_bar_open(decisions, hourly)
    return shown(
        out.select("run_id", "symbol", "ts", "exec_ts", "exec_open"), plain=("exec_open",)
    )


@query(
    with_tables(
        "SELECT symbol, ts, close FROM ("
        "SELECT symbol, ts, close FROM hourly WHERE ts < TIMESTAMP '2024-01-20' "
        "AND NOT (ts >= TIMESTAMP '2024-01-10' AND hour(ts) % 2 = 0) "
        "UNION ALL SELECT symbol, ts, close * 2 FROM hourly "
        "WHERE ts >= TIMESTAMP '2024-01-10' AND hour(ts) % 2 = 0)"
    )
)
def upserted_bars(spark, sf):
    hourly = fx.hourly_bars(spark, sf)
    clock = markettime.utc_clock(F.col("ts"))
    split = lambda day: F.lit(dt.datetime(2024, 1, day, tzinfo=dt.timezone.utc))
    old = hourly.filter(F.col("ts") < split(20))
    new = hourly.filter((F.col("ts") >= split(10)) & (F.hour(clock) % 2 == 0)).withColumn(
        "close", F.col("close") * 2
    )
    return shown(coverage.upsert_bars(old, new).select("symbol", "ts", "close"), plain=("close",))


@query(
    "SELECT DISTINCT p_type AS symbol FROM part WHERE p_type NOT IN "
    "(SELECT p_type FROM part WHERE p_brand = 'Brand#1' AND p_size < 10)"
)
def unknown_symbols(spark, sf):
    parts = fx.table(spark, sf, "part").withColumn("symbol", F.col("p_type"))
    known = parts.filter((F.col("p_brand") == "Brand#1") & (F.col("p_size") < 10))
    return bars.unknown_symbols(parts, known)


@query(
    with_tables(
        f"SELECT {_BARS} FROM days WHERE symbol IN "
        "(SELECT p_brand FROM part GROUP BY p_brand HAVING avg(p_size) > 25)"
    )
)
def bars_of_kept_symbols(spark, sf):
    keep = (
        fx.table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("symbol"))
        .agg(F.avg("p_size").alias("size"))
        .filter(F.col("size") > 25)
    )
    return shown(bars.keep_symbols(fx.brand_days(spark, sf), keep), plain=_PLAIN)


@query(
    with_tables(
        "SELECT c.date, coalesce(n.bars, 0) AS bars, "
        "CASE WHEN half THEN 4 ELSE 7 END::BIGINT AS expected, half AS is_half_day FROM ("
        "SELECT d::DATE AS date, day(d) = 15 AS half FROM (SELECT unnest(generate_series("
        f"(SELECT min(CAST({et('ts')} AS DATE)) FROM hourly)::TIMESTAMP, "
        f"(SELECT max(CAST({et('ts')} AS DATE)) FROM hourly)::TIMESTAMP, INTERVAL 1 DAY)) AS d) "
        "WHERE isodow(d) < 6) c LEFT JOIN (SELECT CAST(et AS DATE) AS date, "
        "count(DISTINCT ts) AS bars FROM "
        f"(SELECT ts, {et('ts')} AS et FROM hourly) "
        "WHERE hour(et) * 60 + minute(et) < 960 AND hour(et) * 60 + minute(et) + 60 > 570 "
        "GROUP BY 1) n USING (date)"
    )
)
def session_bar_counts(spark, sf):
    hourly = fx.hourly_bars(spark, sf)
    regular = bars.filter_session(hourly, "1Hour")
    days = records.typed_calendar(fx.calendar(hourly))
    return bars.session_counts(regular, days, "1Hour")


@query(
    with_tables(
        "SELECT symbol, exchange, tradable, shortable FROM assets "
        "WHERE exchange IN ('ASIA', 'EUROPE', 'AMERICA') AND tradable AND shortable"
    )
)
def shortable_universe(spark, sf):
    return coverage.filter_universe(
        fx.universe(spark, sf), ("asia", "europe", "america"), shortable_only=True
    )


@query(
    with_tables(
        "SELECT symbol, exchange, tradable, shortable FROM assets "
        "WHERE exchange IN ('ASIA', 'EUROPE') AND tradable"
    )
)
def universe_file(spark, sf):
    folder = scratch_folder(spark, "universe")
    fx.universe(spark, sf).write.json(folder)
    read = records.read_universe(spark, folder, ("ASIA", "EUROPE"))
    return read.select("symbol", "exchange", "tradable", "shortable")


# -- coverage ------------------------------------------------------------------


@query(with_tables("SELECT symbol, kind, gap_start, gap_end FROM gaps"))
def coverage_gaps(spark, sf):
    days = fx.brand_days(spark, sf)
    return coverage.coverage_gaps(fx.requests(days), fx.first_half(days))


@query(
    with_tables(
        "SELECT gap_start, gap_end, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols "
        "FROM gaps GROUP BY 1, 2"
    )
)
def batched_requests(spark, sf):
    days = fx.brand_days(spark, sf)
    gaps = coverage.coverage_gaps(fx.requests(days), fx.first_half(days))
    return coverage.batch_by_window(gaps).withColumn("symbols", F.array_join("symbols", ","))


@query(
    with_tables(
        "SELECT symbol, CASE WHEN gap_start > cov_end + 1 OR gap_end < cov_start - 1 "
        "THEN gap_start ELSE least(gap_start, cov_start) END AS cov_start, "
        "least(CASE WHEN gap_start > cov_end + 1 OR gap_end < cov_start - 1 "
        "THEN gap_end ELSE greatest(gap_end, cov_end) END, DATE '2001-11-10') AS cov_end "
        "FROM covered JOIN (SELECT * FROM gaps WHERE kind = 'later') USING (symbol) "
        "WHERE least(CASE WHEN gap_start > cov_end + 1 THEN gap_end "
        "ELSE greatest(gap_end, cov_end) END, DATE '2001-11-10') >= "
        "CASE WHEN gap_start > cov_end + 1 THEN gap_start ELSE least(gap_start, cov_start) END"
    )
)
def merged_coverage(spark, sf):
    days = fx.brand_days(spark, sf)
    half = fx.first_half(days)
    loaded = (
        coverage.coverage_gaps(fx.requests(days), half)
        .filter(F.col("kind") == "later")
        .select("symbol", F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))
    )
    return coverage.merge_coverage(half, loaded, dt.date(2001, 11, 10))


@query(
    "SELECT event_id, CASE WHEN ts + INTERVAL 4 HOUR <= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 16 MINUTE "
    "OR ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 16 MINUTE THEN NULL "
    "ELSE TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 16 MINUTE END AS capped FROM "
    "(SELECT event_id, date_trunc('second', ts) AS ts FROM events)"
)
def embargoed_requests(spark, sf):
    """Requests from each event's time on, for four hours, seen from one moment."""
    events = fx.table(spark, sf, "events").withColumn("ts", markettime.from_utc(F.col("ts")))
    start = fx.iso(F.col("ts"))
    end = fx.iso(F.col("ts") + F.expr("INTERVAL 4 HOURS"))
    now = F.lit(dt.datetime(2024, 1, 15, 12, tzinfo=dt.timezone.utc))
    return shown(events.select("event_id", coverage.cap_recent(start, end, now).alias("capped")))


@query("SELECT o_orderkey, o_orderdate < TIMESTAMP '2016-01-04' AS early FROM orders")
def requests_before_history(spark, sf):
    orders = fx.table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    return orders.select("o_orderkey", coverage.before_history_floor(day).alias("early"))


@query(with_tables(f"SELECT {_BARS} FROM days WHERE symbol IN ('Brand#1', 'Brand#2')"))
def stored_bars(spark, sf):
    """Two loads into a bar table, the second correcting the first; then two symbols."""
    days = fx.brand_days(spark, sf)
    store = BarStore(spark, scratch_folder(spark, "store"))
    spans = coverage.coverage_of(days)
    windows = spans.select(
        "symbol", F.col("cov_start").alias("start"), F.col("cov_end").alias("end")
    )
    wrong = days.filter(F.year("ts") < 1999).withColumn("close", F.lit(1.0))
    store.load("1Day", wrong, windows)
    store.load("1Day", days, windows)
    return shown(store.read("1Day", ["Brand#1", "Brand#2"]), plain=_PLAIN)


@query(
    with_tables("SELECT symbol, cov_start, cov_end, n AS rows FROM day_spans")
)
def stored_coverage(spark, sf):
    days = fx.brand_days(spark, sf)
    store = BarStore(spark, scratch_folder(spark, "store"))
    windows = coverage.coverage_of(days).select(
        "symbol", F.col("cov_start").alias("start"), F.col("cov_end").alias("end")
    )
    store.load("1Day", days, windows)
    return store.read_coverage("1Day").select("symbol", "cov_start", "cov_end", "rows")


@query(with_tables(f"SELECT {_BARS} FROM hourly"))
def parquet_round_trip(spark, sf):
    path = tables.write_table(fx.hourly_bars(spark, sf), scratch_folder(spark, "bars"))
    return shown(tables.read_table(spark, path), plain=_PLAIN)


@query(with_tables(f"SELECT {_BARS} FROM hourly"))
def csv_round_trip(spark, sf):
    hourly = fx.hourly_bars(spark, sf)
    path = tables.write_table(hourly, scratch_folder(spark, "bars") + ".csv")
    return shown(tables.read_table(spark, path, schema=hourly.schema), plain=_PLAIN)


@query(
    with_tables(
        f"SELECT {_BARS} FROM days WHERE symbol IN ('Brand#3', 'Brand#4') "
        f"AND CAST({et('ts')} AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"
    )
)
def exported_bars(spark, sf):
    days = fx.brand_days(spark, sf)
    store = BarStore(spark, scratch_folder(spark, "store"))
    windows = coverage.coverage_of(days).select(
        "symbol", F.col("cov_start").alias("start"), F.col("cov_end").alias("end")
    )
    store.load("1Day", days, windows)
    path = scratch_folder(spark, "export") + ".csv"
    tables.export_bars(store, path, ["Brand#3", "Brand#4"], "1997-01-01", "1998-12-31")
    kinds = {f.name: f for f in days.schema.fields}
    schema = T.StructType([kinds[c] for c in ["ts", "symbol", *BAR_FIELDS]])
    return shown(tables.read_table(spark, path, schema=schema), plain=_PLAIN)


# -- scalars -------------------------------------------------------------------


@query(
    with_tables(
        f"SELECT event_id, {et('ts')} AS et, CAST({et('ts')} AS DATE) AS market_date, "
        f"(hour({et('ts')}) * 60 + minute({et('ts')}))::INT AS minute FROM ticks"
    )
)
def market_times(spark, sf):
    events = fx.table(spark, sf, "events").filter(F.col("value") > 0)
    ts = markettime.from_utc(F.col("ts"))
    return events.select(
        "event_id",
        markettime.in_zone(ts).alias("et"),
        markettime.market_date(ts).alias("market_date"),
        markettime.minute_of_day(ts).alias("minute"),
    )


@query(
    with_tables(
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
        + ", ".join(
            [
                rnd("fill", "fill"),
                rnd("CASE WHEN shares = 0 THEN 0 ELSE greatest(abs(shares) * 0.005e0 + "
                    "abs(shares * fill) * 3e0 / 10000, 1e0) END", "commission"),
                rnd("shares * fill", "notional", 2),
                rnd("abs(shares) * abs(fill - price)", "slippage_cost"),
                "CASE WHEN shares > 0 THEN 'buy' ELSE 'sell' END AS side",
                "trunc(shares / 7) AS whole",
                rnd("coalesce(shares * price / nullif(l_extendedprice, 0), 0)", "weight"),
            ]
        )
        + " FROM (SELECT *, price * (1 + CASE WHEN shares > 0 THEN 1 ELSE -1 END * 5e0 / 10000) AS fill "
        "FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN -size ELSE size END AS shares FROM trades))"
    )
)
def order_costs(spark, sf):
    shares = F.when(F.col("l_returnflag") == "R", -F.col("size")).otherwise(F.col("size"))
    rows = fx.trades(spark, sf).withColumn("shares", shares)
    rows = rows.withColumn(
        "fill", trading.fill_price(F.col("price"), F.col("shares"), F.lit(5.0))
    )
    s, p = F.col("shares"), F.col("fill")
    out = rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "fill",
        trading.commission(s, p, F.lit(0.005), F.lit(3.0), F.lit(1.0)).alias("commission"),
        trading.notional(s, p).alias("notional"),
        trading.slippage_cost(s, p, F.col("price")).alias("slippage_cost"),
        trading.side(s).alias("side"),
        trading.whole_shares(s / 7).alias("whole"),
        trading.position_weight(s, F.col("price"), F.col("l_extendedprice")).alias("weight"),
    )
    return shown(out, notional=2)


@query(
    "SELECT p_partkey, CASE WHEN p_size % 60 = 0 THEN NULL ELSE (p_size % 60) || CASE p_size % 5 "
    "WHEN 0 THEN 'Min' WHEN 1 THEN 'Hour' WHEN 2 THEN 'Day' WHEN 3 THEN 'Week' ELSE 'Month' END END AS label, "
    + rnd(
        "CASE p_size % 5 WHEN 0 THEN 252e0 * 390 / p_size WHEN 1 THEN 252 * 6.5e0 / p_size "
        "WHEN 2 THEN 252e0 / p_size WHEN 3 THEN 52e0 / p_size ELSE 12e0 / p_size END",
        "per_year",
    )
    + " FROM part"
)
def timeframe_labels(spark, sf):
    """Bar lengths written in many ways, from part sizes."""
    parts = fx.table(spark, sf, "part")
    units = F.array(*[F.lit(u) for u in ("min", "HOUR", "days", "Weeks", "months")])
    kinds = F.array(*[F.lit(u) for u in ("min", "hour", "day", "week", "month")])
    pick = F.col("p_size") % 5
    text = F.concat(F.lit(" "), F.col("p_size"), F.lit(" "), units[pick])
    return shown(
        parts.select(
            "p_partkey",
            timeframe.timeframe_label(text).alias("label"),
            timeframe.periods_per_year(F.col("p_size"), kinds[pick], F.lit(390.0)).alias(
                "per_year"
            ),
        )
    )


@query(
    "SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), ''), 'run') "
    "AS slug FROM pages"
)
def run_slugs(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", trading.slug(F.col("url")).alias("slug"))


@query(
    "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter("
    "regexp_split_to_array(upper(replace(p_name, ' ', ', ') || ' ' || p_type || ',' || p_type), '[,\\s]+'), "
    "lambda s: s <> ''))), ',') AS symbols FROM part"
)
def symbol_lists(spark, sf):
    text = F.concat(
        F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(" "), "p_type", F.lit(","), "p_type"
    )
    symbols = F.array_join(trading.symbol_list(text), ",")
    return fx.table(spark, sf, "part").select("p_partkey", symbols.alias("symbols"))


# -- indicators ----------------------------------------------------------------


def _day_panel(spark, sf):
    return bars.with_seq(fx.brand_days(spark, sf)).select("symbol", "ts", "seq", "close")


@query(with_tables("SELECT run_id AS symbol, ts, " + rnd("r") + " FROM day_returns"))
def day_returns(spark, sf):
    out = indicators.bar_returns(_day_panel(spark, sf), chunk_rows=300)
    return shown(out.select("symbol", "ts", "r"))


def _full(fn: str, n: int) -> str:
    w = f"(PARTITION BY symbol ORDER BY seq RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) OVER {w} = {n} THEN {fn}(close) OVER {w} END"


@query(
    with_tables(
        f"SELECT symbol, ts, {rnd(_full('avg', 3), 'sma_3')}, {rnd(_full('avg', 5), 'sma_5')} FROM day_panel"
    )
)
def moving_averages(spark, sf):
    out = indicators.sma(_day_panel(spark, sf), [3, 5], chunk_rows=300)
    return shown(out.select("symbol", "ts", "sma_3", "sma_5"))


@query(with_tables(f"SELECT symbol, ts, {rnd(_full('stddev_samp', 4), 'std_4')} FROM day_panel"))
def rolling_deviation(spark, sf):
    out = indicators.rolling_std(_day_panel(spark, sf), 4, chunk_rows=300)
    return shown(out.select("symbol", "ts", "std_4"))


_Z4 = f"(close - {_full('avg', 4)}) / nullif({_full('stddev_samp', 4)}, 0)"


@query(with_tables(f"SELECT symbol, ts, {rnd(_Z4, 'z_4')} FROM day_panel"))
def zscores(spark, sf):
    out = indicators.zscore(_day_panel(spark, sf), [4], chunk_rows=300)
    return shown(out.select("symbol", "ts", "z_4"))


@query(
    with_tables(
        "SELECT symbol, ts, z_4 AS z, rank FROM (SELECT *, row_number() OVER (PARTITION BY ts "
        "ORDER BY raw, symbol) AS rank FROM (SELECT symbol, ts, "
        f"{_Z4} AS raw, {rnd(_Z4, 'z_4')} FROM day_panel) WHERE raw IS NOT NULL) WHERE rank <= 3"
    )
)
def most_oversold(spark, sf):
    scored = indicators.zscore(_day_panel(spark, sf), [4])
    top = indicators.most_oversold(scored, "z_4", 3)
    return shown(top.select("symbol", "ts", F.col("z_4").alias("z"), "rank"))


@query(
    with_tables(
        "SELECT symbol, ts, seq, seq >= 20 AND seq < (SELECT max(seq) FROM day_line) AS can_decide "
        "FROM day_panel"
    )
)
def decision_bars(spark, sf):
    return shown(indicators.bar_index(_day_panel(spark, sf), 20)).drop("close")


@query(
    with_tables(
        "SELECT symbol, ts, array_to_string(list(seq) OVER w, ',') AS seqs, "
        + rnd("sum(close) OVER w", "total")
        + " FROM day_panel WINDOW w AS (PARTITION BY symbol ORDER BY seq RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)"
    )
)
def recent_history(spark, sf):
    past = indicators.history(_day_panel(spark, sf), 5, chunk_rows=300)
    total = F.aggregate("history", F.lit(0.0), lambda t, h: t + h["value"])
    seqs = F.array_join(F.transform("history", lambda h: h["seq"].cast("string")), ",")
    return shown(past.select("symbol", "ts", seqs.alias("seqs"), total.alias("total")))


@query(
    with_tables(
        "SELECT symbol, ts, last_value(high IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS filled "
        "FROM (SELECT symbol, ts, CASE WHEN trade_count > 2 THEN high END AS high FROM hourly)"
    )
)
def forward_filled(spark, sf):
    gappy = fx.hourly_bars(spark, sf).select(
        "symbol", "ts", F.when(F.col("trade_count") > 2, F.col("high")).alias("high")
    )
    out = indicators.forward_fill(gappy, ["symbol"], "high", "filled", chunk_seconds=3 * 86400)
    return shown(out.select("symbol", "ts", "filled"), plain=("filled",))


@query(
    with_tables(
        f"SELECT {_BARS.replace('symbol', 'upper(symbol) AS symbol', 1)} FROM hourly "
        f"WHERE symbol IN ('click', 'view') AND CAST({et('ts')} AS DATE) BETWEEN DATE '2024-01-04' AND DATE '2024-01-11' "
        f"AND hour({et('ts')}) * 60 + minute({et('ts')}) < 960 AND hour({et('ts')}) * 60 + minute({et('ts')}) + 60 > 570"
    )
)
def loaded_bars(spark, sf):
    """Bars of two symbols, fetched in two overlapping requests and read in a third."""
    made = fx.hourly_bars(spark, sf).withColumn("symbol", F.upper("symbol"))
    store = BarStore(spark, scratch_folder(spark, "store"))

    def fetch(gaps):
        day = markettime.market_date(F.col("ts"))
        return made.join(gaps, "symbol").filter(day.between(F.col("gap_start"), F.col("gap_end")))

    first, middle, last = dt.date(2024, 1, 4), dt.date(2024, 1, 8), dt.date(2024, 1, 11)
    names = [" view", "CLICK", "view"]
    load_bars(store, "1Hour", names, middle, last, fetch=fetch)
    load_bars(store, "1Hour", names, first, middle, fetch=fetch)
    return shown(load_bars(store, "1Hour", names, first, last), plain=_PLAIN)


@query(with_tables(f"SELECT {_BARS} FROM days"))
def stored_bars_of_gaps(spark, sf):
    """Bars loaded for every window that several requests of a symbol lack."""
    days = fx.brand_days(spark, sf)
    store = BarStore(spark, scratch_folder(spark, "store"))
    wanted = fx.requests(days).filter("kind IN ('all', 'half')")
    gaps = coverage.coverage_gaps(wanted, store.read_coverage("1Day"))
    windows = gaps.selectExpr("symbol", "gap_start AS start", "gap_end AS end")
    store.load("1Day", days, windows)
    return shown(store.read("1Day"), plain=_PLAIN)


@query(
    "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, '09:30' AS open, '16:00' AS close FROM orders"
)
def calendar_file(spark, sf):
    """A calendar written as JSON lines and read back."""
    days = fx.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    path = scratch_folder(spark, "calendar")
    days.withColumns({"open": F.lit("09:30"), "close": F.lit("16:00")}).write.json(path)
    return records.read_calendar(spark, path).select("date", "open", "close")
