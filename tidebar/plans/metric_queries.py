"""Queries on return series and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import bars, indicators, metrics, report
from tidebar.plans import fixtures as fx
from tidebar.plans.registry import query, shown
from tidebar.plans.sql import et, rnd, with_tables

_HOURS_PER_YEAR = 252 * 6.5


def _tamed(r):
    """Returns within 2 %: prices here are unrelated numbers, whose own returns
    would compound beyond all bounds."""
    return 0.02 * r / (2 + r)


def _day_returns(spark, sf):
    """Returns per brand; gaps leave NULLs that the statistics skip."""
    panel = bars.with_seq(fx.brand_days(spark, sf)).select("symbol", "ts", "seq", "close")
    out = indicators.bar_returns(panel, chunk_rows=None)
    return out.select(F.col("symbol").alias("run_id"), "ts", "r")


def _bench_returns(spark, sf):
    bench = fx.benchmark_days(spark, sf).withColumn("run_id", F.lit("b"))
    out = metrics.equity_returns(bench.withColumnRenamed("close", "equity"))
    return out.select("ts", "r")


# One row per run with all statistics of series ``rs(run_id, ts, r)``.
def stats_tables(returns: str, periods: float, risk_free: float = 0.0) -> dict[str, str]:
    p, rf = f"{periods!r}::DOUBLE", f"({risk_free / periods!r}::DOUBLE)"
    return {
        "rs": f"SELECT run_id, ts, r, r - {rf} AS x FROM ({returns}) WHERE isfinite(r)",
        "curves": (
            "SELECT *, product(1 + r) OVER (PARTITION BY run_id ORDER BY ts) AS growth FROM rs"
        ),
        "falls": (
            "SELECT *, growth / max(growth) OVER (PARTITION BY run_id ORDER BY ts) - 1 AS drawdown, "
            "row_number() OVER (PARTITION BY run_id ORDER BY ts) AS n FROM curves"
        ),
        "islands": (
            "SELECT *, n - coalesce(max(CASE WHEN drawdown >= 0 THEN n END) "
            "OVER (PARTITION BY run_id ORDER BY ts), 0) AS under FROM falls"
        ),
        "tails": "SELECT run_id, quantile_cont(r, 0.05) AS var_95 FROM rs GROUP BY run_id",
        "tail_means": (
            "SELECT run_id, avg(r) AS cvar_95 FROM rs JOIN tails USING (run_id) "
            "WHERE r <= var_95 GROUP BY run_id"
        ),
        "stat": f"""
        SELECT run_id, count(*)::DOUBLE AS periods, product(1 + r) - 1 AS total_return,
          CASE WHEN product(1 + r) > 0 THEN pow(product(1 + r), {p} / count(*)) - 1 ELSE 0 END AS cagr,
          coalesce(stddev_samp(r), 0) * sqrt({p}) AS volatility,
          CASE WHEN count(*) > 1 AND max(r) > min(r) THEN avg(x) / stddev_samp(x) * sqrt({p}) ELSE 0 END AS sharpe,
          CASE WHEN count(*) < 2 THEN 0 WHEN count(*) FILTER (x < 0) = 0
            THEN CASE WHEN avg(x) > 0 THEN 'inf'::DOUBLE ELSE 0 END
            ELSE avg(x) / sqrt(sum(x * x) FILTER (x < 0) / count(*)) * sqrt({p}) END AS sortino,
          min(drawdown) AS max_drawdown, max(under)::DOUBLE AS max_drawdown_bars,
          coalesce(avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) FILTER (r <> 0), 0) AS win_rate,
          CASE WHEN coalesce(sum(r) FILTER (r < 0), 0) = 0
            THEN CASE WHEN coalesce(sum(r) FILTER (r > 0), 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END
            ELSE coalesce(sum(r) FILTER (r > 0), 0) / -sum(r) FILTER (r < 0) END AS profit_factor,
          max(r) AS best_period, min(r) AS worst_period
        FROM islands GROUP BY run_id""",
    }


_STATS = [
    "periods",
    "total_return",
    "cagr",
    "volatility",
    "sharpe",
    "sortino",
    "max_drawdown",
    "max_drawdown_bars",
    "win_rate",
    "profit_factor",
    "best_period",
    "worst_period",
]


_STATS_FROM = (
    "FROM stat s JOIN tails USING (run_id) JOIN tail_means USING (run_id)"
)


_ETM = f"(hour({et('ts')}) * 60 + minute({et('ts')}))"
_SESSION = {
    "session": f"SELECT * FROM hourly WHERE {_ETM} < 960 AND {_ETM} + 60 > 570",
    "session_line": "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS seq FROM (SELECT DISTINCT ts FROM session)",
    "session_returns": (
        "SELECT symbol AS run_id, ts, 0.02e0 * r / (2 + r) AS r FROM (SELECT symbol, ts, close / max(close) OVER "
        "(PARTITION BY symbol ORDER BY seq RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS r "
        "FROM session JOIN session_line USING (ts))"
    ),
}


def _session_returns(spark, sf):
    """Hourly returns in the regular session."""
    regular = bars.filter_session(fx.hourly_bars(spark, sf), "1Hour")
    panel = bars.with_seq(regular).select("symbol", "ts", "seq", "close")
    out = indicators.bar_returns(panel)
    return out.select(F.col("symbol").alias("run_id"), "ts", _tamed(F.col("r")).alias("r"))


_STAT_LIST = ", ".join(
    ["s.run_id", *[rnd(f"s.{c}", c) for c in _STATS]]
    + [
        rnd("CASE WHEN s.max_drawdown = 0 THEN 0 ELSE s.cagr / abs(s.max_drawdown) END", "calmar"),
        rnd("var_95"),
        rnd("cvar_95"),
    ]
)


@query(
    with_tables(
        f"SELECT {_STAT_LIST} {_STATS_FROM}",
        **_SESSION,
        **stats_tables("SELECT * FROM session_returns", _HOURS_PER_YEAR, 0.02),
    )
)
def session_statistics(spark, sf):
    return shown(metrics.performance_stats(_session_returns(spark, sf), "1Hour", risk_free=0.02))


_SCALED = "SELECT run_id, ts, 0.02e0 * r / (2 + r) AS r FROM day_returns"


def _scaled_days(spark, sf):
    return _day_returns(spark, sf).withColumn("r", _tamed(F.col("r")))


@query(
    with_tables(f"SELECT {_STAT_LIST} {_STATS_FROM}", **stats_tables(_SCALED, 252.0))
)
def brand_statistics(spark, sf):
    """Daily statistics, the series scanned in chunks of 200 days."""
    stats = metrics.performance_stats(
        _scaled_days(spark, sf), "1Day", chunk_seconds=200 * 86400
    )
    return shown(stats)


@query(
    with_tables(
        "SELECT run_id, ts, " + rnd("growth") + ", " + rnd("drawdown") + ", "
        "under AS underwater_bars FROM islands",
        **stats_tables(_SCALED, 252.0),
    )
)
def drawdown_islands(spark, sf):
    chunk = 150 * 86400
    falls = metrics.return_drawdown(
        metrics.clean_returns(_scaled_days(spark, sf)), chunk_seconds=chunk
    )
    out = metrics.underwater(falls, chunk_seconds=chunk)
    return shown(
        out.select(
            "run_id", "ts", "growth", "drawdown", F.col("underwater_bars").cast("long").alias("underwater_bars")
        )
    )


@query(
    with_tables(
        "SELECT run_id, ts, " + rnd("growth") + " FROM curves", **stats_tables(_SCALED, 252.0)
    )
)
def growth_curves(spark, sf):
    returns = metrics.clean_returns(_scaled_days(spark, sf))
    return shown(metrics.growth_curve(returns, chunk_seconds=150 * 86400)).drop("r")


@query(
    with_tables(
        "SELECT run_id, ts, r FROM (" + "SELECT run_id, ts, r FROM day_returns" + ") WHERE isfinite(r)"
    )
)
def finite_returns(spark, sf):
    return shown(metrics.clean_returns(_day_returns(spark, sf)), plain=("r",))


@query(
    with_tables(
        "SELECT symbol, ts, " + rnd("coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0)", "r")
        + ", " + rnd("close / max(close) OVER (PARTITION BY symbol ORDER BY ts) - 1", "drawdown")
        + " FROM days"
    )
)
def equity_returns_and_drawdown(spark, sf):
    curves = fx.brand_days(spark, sf).select("symbol", "ts", F.col("close").alias("equity"))
    chunk = 100 * 86400
    out = metrics.equity_returns(curves, ["symbol"], chunk_seconds=chunk)
    out = metrics.drawdown(out, "equity", ["symbol"], chunk_seconds=chunk)
    return shown(out.select("symbol", "ts", "r", "drawdown"))


@query(
    "SELECT o_orderpriority AS run_id, "
    + rnd("quantile_cont(o_totalprice, 0.05)", "p05", 4)
    + " FROM orders GROUP BY 1 UNION ALL SELECT 'all', "
    + rnd("quantile_cont(o_totalprice, 0.05)", "p05", 4)
    + " FROM orders"
)
def exact_quantiles(spark, sf):
    """Large groups are bracketed by a sketch first, small ones ranked whole."""
    orders = fx.table(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    both = orders.select(
        F.explode(F.array("o_orderpriority", F.lit("all"))).alias("run_id"),
        F.col("o_totalprice").alias("r"),
    )
    return shown(metrics.value_at_risk(both, out="p05"), 4)


_BENCH = {
    "bench_r": "SELECT ts, coalesce(close / lag(close) OVER (ORDER BY ts) - 1, 0) AS b FROM bench",
    "pairs": "SELECT run_id, ts, r, b FROM rs JOIN bench_r USING (ts)",
    "fits": (
        "SELECT run_id, CASE WHEN count(*) > 1 AND max(b) > min(b) THEN covar_samp(r, b) / var_samp(b) END AS beta, "
        "avg(r) AS mr, avg(b) AS mb FROM pairs GROUP BY run_id"
    ),
}


@query(
    with_tables(
        "SELECT run_id, ts, r, " + rnd("b") + " FROM pairs",
        **stats_tables("SELECT run_id, ts, r FROM day_returns", 252.0),
        **_BENCH,
    )
)
def shared_bar_returns(spark, sf):
    pairs = metrics.join_on_shared_bars(_day_returns(spark, sf), _bench_returns(spark, sf))
    return shown(pairs.select("run_id", "ts", "r", "b"), plain=("r",))


@query(
    with_tables(
        f"SELECT {_STAT_LIST}, " + rnd("coalesce(beta, 0)", "beta", 8) + ", "
        + rnd("coalesce((mr - beta * mb) * 252, 0)", "alpha") + ", "
        + rnd("bs.total", "benchmark_return") + ", " + rnd("bs.sharpe", "benchmark_sharpe") + ", "
        + rnd("s.total_return - bs.total", "excess_return")
        + f" {_STATS_FROM} LEFT JOIN fits f USING (run_id), bench_stat bs",
        **stats_tables(_SCALED, 252.0),
        **{
            **_BENCH,
            "bench_r": "SELECT ts, 0.02e0 * b / (2 + b) AS b FROM "
            "(SELECT ts, coalesce(close / lag(close) OVER (ORDER BY ts) - 1, 0) AS b FROM bench)",
        },
        bench_stat=(
            "SELECT product(1 + b) - 1 AS total, avg(b) / stddev_samp(b) * sqrt(252e0) AS sharpe "
            "FROM bench_r"
        ),
    )
)
def benchmark_statistics(spark, sf):
    bench = _bench_returns(spark, sf).withColumn("r", _tamed(F.col("r")))
    stats = metrics.performance_stats(_scaled_days(spark, sf), "1Day", benchmark=bench)
    return shown(stats, beta=8)


@query(
    with_tables(
        "SELECT ts, " + rnd("close", "close") + ", "
        + rnd("coalesce(close / lag(close) OVER (ORDER BY ts) - 1, 0)", "r")
        + " FROM (SELECT ts, last_value(b.close IGNORE NULLS) OVER (ORDER BY ts) AS close "
        "FROM day_line LEFT JOIN (SELECT * FROM bench WHERE day(ts) % 3 <> 0) b USING (ts))"
    )
)
def aligned_benchmark(spark, sf):
    line = bars.scans.timeline(fx.brand_days(spark, sf)).select("ts")
    sparse = fx.benchmark_days(spark, sf).filter(F.dayofmonth(fx.utc_clock(F.col("ts"))) % 3 != 0)
    return shown(metrics.align_benchmark(line, sparse, chunk_seconds=300 * 86400))


def _display_sql() -> str:
    percent = ", ".join(f"'{k}'" for k in report.PERCENT_KEYS)
    long = " UNION ALL ".join(
        f"SELECT run_id, '{c}' AS metric, {c} AS value FROM full_stat"
        for c in [*_STATS, "calmar", "var_95", "cvar_95"]
    )
    return with_tables(
        f"""SELECT run_id, replace(metric, '_', ' ') AS metric,
        CASE WHEN isinf(value) THEN '∞'
          WHEN metric IN ({percent}) THEN format('{{:,.2f}}%', value * 100)
          WHEN value = floor(value) AND abs(value) < 1e9 THEN format('{{:,}}', value::BIGINT)
          ELSE format('{{:,.4f}}', value) END AS shown FROM ({long})""",
        full_stat=f"SELECT {_STAT_LIST} {_STATS_FROM}",
        **_SESSION,
        **stats_tables("SELECT * FROM session_returns", _HOURS_PER_YEAR, 0.02),
    )


@query(_display_sql())
def statistics_as_text(spark, sf):
    return report.format_stats(session_statistics(spark, sf))
