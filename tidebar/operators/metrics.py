"""Performance statistics of return series, for any number of runs at once.

Input is one row per run and bar: ``run_id, ts, r`` with simple returns. Infinite
and missing returns are left out of every statistic. ``chunk_seconds`` (see
:meth:`TimeFrame.chunk_seconds`) bounds the rows one task scans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.timeframe import TimeFrame
from tidebar.functions.trading import finite
from tidebar.operators import scans

KEYS = ("run_id",)
INFINITY = float("inf")


def clean_returns(returns: DataFrame) -> DataFrame:
    return returns.filter(finite(F.col("r")).isNotNull())


# -- series --------------------------------------------------------------------


def equity_returns(
    equity: DataFrame, keys: Sequence[str] = KEYS, chunk_seconds: int | None = None
) -> DataFrame:
    """Return from bar to bar as ``r``; 0 on the first bar."""
    out = scans.previous(
        equity,
        keys,
        ["ts"],
        scans.time_chunk(F.col("ts"), chunk_seconds),
        F.col("equity"),
        "__before",
    )
    r = F.coalesce(F.try_divide(F.col("equity"), F.col("__before")) - 1, F.lit(0.0))
    return out.withColumn("r", r).drop("__before")


def growth_curve(
    returns: DataFrame, keys: Sequence[str] = KEYS, chunk_seconds: int | None = None
) -> DataFrame:
    """Compounded growth of 1 as ``growth``."""
    return scans.running(
        returns,
        keys,
        ["ts"],
        scans.time_chunk(F.col("ts"), chunk_seconds),
        growth=scans.running_product(1 + F.col("r")),
    )


def drawdown(
    series: DataFrame,
    value: str,
    keys: Sequence[str] = KEYS,
    chunk_seconds: int | None = None,
) -> DataFrame:
    """Loss against the highest value so far; the first bar is the first peak."""
    peaked = scans.running(
        series,
        keys,
        ["ts"],
        scans.time_chunk(F.col("ts"), chunk_seconds),
        __peak=scans.running_max(F.col(value)),
    )
    loss = F.try_divide(F.col(value), F.col("__peak")) - 1
    return peaked.withColumn("drawdown", loss).drop("__peak")


def return_drawdown(
    returns: DataFrame, keys: Sequence[str] = KEYS, chunk_seconds: int | None = None
) -> DataFrame:
    """``growth`` and ``drawdown`` of returns in one scan per chunk.

    Growth before a chunk scales its local curve, so its local extremes scale to
    the peak as well; a negative factor swaps highest and lowest.
    """
    chunk = scans.time_chunk(F.col("ts"), chunk_seconds)
    whole = chunk is None
    marked = returns.withColumn(scans.CHUNK, F.lit(0) if whole else scans.never_null(chunk))
    at = list(keys) if whole else [*keys, scans.CHUNK]
    upto = (
        Window.partitionBy(*at)
        .orderBy("ts")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = marked.withColumn("__p", F.product(1 + F.col("r")).over(upto)).withColumns(
        {"__hi": F.max("__p").over(upto), "__lo": F.min("__p").over(upto)}
    )
    if whole:
        out = local.withColumns({"growth": F.col("__p"), "__peak": F.col("__hi")})
    else:
        before = (
            Window.partitionBy(*keys)
            .orderBy(scans.CHUNK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        ends = local.groupBy(*at).agg(
            F.product(1 + F.col("r")).alias("__f"),
            F.max("__p").alias("__top"),
            F.min("__p").alias("__low"),
        )
        ends = (
            ends.withColumn("__past", F.coalesce(F.product("__f").over(before), F.lit(1.0)))
            .withColumn(
                "__past_peak",
                F.max(
                    F.col("__past")
                    * F.when(F.col("__past") >= 0, F.col("__top")).otherwise(F.col("__low"))
                ).over(before),
            )
            .select(*at, "__past", "__past_peak")
        )
        best = F.when(F.col("__past") >= 0, F.col("__hi")).otherwise(F.col("__lo"))
        out = local.join(ends, at).withColumns(
            {
                "growth": F.col("__past") * F.col("__p"),
                "__peak": F.greatest(F.col("__past_peak"), F.col("__past") * best),
            }
        )
    # Bars without a return are no bars of the series and have no drawdown.
    loss = F.when(F.col("r").isNotNull(), F.try_divide(F.col("growth"), F.col("__peak")) - 1)
    return out.select(*returns.columns, "growth", loss.alias("drawdown"))


def underwater(
    drawdowns: DataFrame, keys: Sequence[str] = KEYS, chunk_seconds: int | None = None
) -> DataFrame:
    """``underwater_bars``: bars since the last peak, 0 on a peak."""
    return scans.streak(
        drawdowns,
        keys,
        ["ts"],
        scans.time_chunk(F.col("ts"), chunk_seconds),
        breaks=F.col("drawdown") >= 0,
        counts=F.col("drawdown").isNotNull(),
        out="underwater_bars",
    )


# -- statistics of one group as aggregate expressions ----------------------------


def _excess(r: Column, periods: float, risk_free: float) -> Column:
    return r - F.lit(risk_free / periods if periods else 0.0)


def total_return(r: Column) -> Column:
    return F.coalesce(F.product(1 + r) - 1, F.lit(0.0))


def cagr(r: Column, periods: float) -> Column:
    growth, n = F.product(1 + r), F.count(r)
    usable = (n > 0) & (growth > 0) & F.lit(periods > 0)
    return F.when(usable, F.pow(growth, F.lit(float(periods)) / n) - 1).otherwise(0.0)


def volatility(r: Column, periods: float) -> Column:
    return F.coalesce(F.stddev_samp(r), F.lit(0.0)) * F.sqrt(F.lit(float(periods)))


def sharpe(r: Column, periods: float, risk_free: float = 0.0) -> Column:
    x = _excess(r, periods, risk_free)
    # Equal returns have no deviation; told by the extremes to be free of rounding.
    varied = (F.count(r) > 1) & (F.max(r) > F.min(r))
    score = F.try_divide(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(float(periods)))
    return F.when(varied, F.coalesce(score, F.lit(0.0))).otherwise(0.0)


def sortino(r: Column, periods: float, risk_free: float = 0.0) -> Column:
    x = _excess(r, periods, risk_free)
    below = F.sqrt(F.sum(F.when(x < 0, x * x)) / F.count(x))
    score = F.try_divide(F.avg(x), below) * F.sqrt(F.lit(float(periods)))
    no_loss = F.when(F.avg(x) > 0, INFINITY).otherwise(0.0)
    return (
        F.when(F.count(x) < 2, 0.0)
        .when(F.count_if(x < 0) == 0, no_loss)
        .otherwise(F.coalesce(score, F.lit(0.0)))
    )


def win_rate(r: Column) -> Column:
    return F.coalesce(F.avg(F.when(r != 0, (r > 0).cast("double"))), F.lit(0.0))


def profit_factor(r: Column) -> Column:
    gains = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0))
    losses = F.coalesce(-F.sum(F.when(r < 0, r)), F.lit(0.0))
    only_gains = F.when(gains > 0, INFINITY).otherwise(0.0)
    return F.when(losses == 0, only_gains).otherwise(F.try_divide(gains, losses))


def value_at_risk(
    returns: DataFrame, keys: Sequence[str] = KEYS, level: float = 0.05, out: str = "var_95"
) -> DataFrame:
    """Exact ``level`` quantile of the returns of each run."""
    return scans.exact_quantile(clean_returns(returns), keys, "r", level, out)


def conditional_value_at_risk(
    returns: DataFrame, keys: Sequence[str] = KEYS, level: float = 0.05
) -> DataFrame:
    """``var_95`` and ``cvar_95``, the mean of the returns at or below it."""
    return scans.exact_quantile(clean_returns(returns), keys, "r", level, "var_95", "cvar_95")


def join_on_shared_bars(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pair returns with the benchmark return ``b`` of the same bar.

    Where both have a column ``benchmark``, that names the series.
    """
    on = [c for c in ("benchmark", "ts") if c in returns.columns and c in benchmark.columns]
    bench = clean_returns(benchmark).select(*on, F.col("r").alias("b"))
    return clean_returns(returns).join(bench, on)


def beta_alpha(
    returns: DataFrame,
    benchmark: DataFrame,
    periods: float,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Slope against the benchmark and the annualised rest, on shared bars."""
    slope = F.when(
        (F.count(F.lit(1)) > 1) & (F.max("b") > F.min("b")),
        F.try_divide(F.covar_samp("r", "b"), F.var_samp("b")),
    )
    fit = (
        join_on_shared_bars(returns, benchmark)
        .groupBy(*keys)
        .agg(slope.alias("beta"), F.avg("r").alias("__r"), F.avg("b").alias("__b"))
    )
    alpha = (F.col("__r") - F.col("beta") * F.col("__b")) * F.lit(float(periods))
    return fit.select(
        *keys,
        F.coalesce("beta", F.lit(0.0)).alias("beta"),
        F.coalesce(alpha, F.lit(0.0)).alias("alpha"),
    )


def performance_stats(
    returns: DataFrame,
    timeframe: str | TimeFrame = "1Day",
    risk_free: float = 0.0,
    benchmark: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    periods: float | None = None,
    chunk_seconds: int | None = -1,
    benchmark_of: DataFrame | None = None,
) -> DataFrame:
    """One row of statistics per run.

    ``periods`` overrides the bars per year of the timeframe, as a market that
    trades around the clock needs. ``benchmark`` is one series (ts, r) for all runs, or several
    (benchmark, ts, r) of which ``benchmark_of`` names one per run; what compares with a benchmark
    is null for runs without any.
    """
    tf = TimeFrame.of(timeframe) if isinstance(timeframe, str) else timeframe
    periods = tf.periods_per_year if periods is None else float(periods)
    chunk = tf.chunk_seconds() if chunk_seconds == -1 else chunk_seconds
    named = returns.select(*keys, "ts", finite(F.col("r")).alias("r"))
    r = F.col("r")
    scanned = underwater(return_drawdown(named, keys, chunk), keys, chunk)
    base = scanned.groupBy(*keys).agg(
        F.count(r).cast("double").alias("periods"),
        total_return(r).alias("total_return"),
        cagr(r, periods).alias("cagr"),
        volatility(r, periods).alias("volatility"),
        sharpe(r, periods, risk_free).alias("sharpe"),
        sortino(r, periods, risk_free).alias("sortino"),
        F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.coalesce(F.max("underwater_bars"), F.lit(0)).cast("double").alias("max_drawdown_bars"),
        win_rate(r).alias("win_rate"),
        profit_factor(r).alias("profit_factor"),
        F.coalesce(F.max(r), F.lit(0.0)).alias("best_period"),
        F.coalesce(F.min(r), F.lit(0.0)).alias("worst_period"),
    )
    calmar = F.coalesce(F.try_divide(F.col("cagr"), F.abs("max_drawdown")), F.lit(0.0))
    stats = base.join(conditional_value_at_risk(named, keys), list(keys), "left").select(
        *keys,
        "periods",
        "total_return",
        "cagr",
        "volatility",
        "sharpe",
        "sortino",
        "max_drawdown",
        "max_drawdown_bars",
        calmar.alias("calmar"),
        "win_rate",
        "profit_factor",
        F.coalesce("var_95", F.lit(0.0)).alias("var_95"),
        F.coalesce("cvar_95", F.lit(0.0)).alias("cvar_95"),
        "best_period",
        "worst_period",
    )
    if benchmark is None:
        return stats
    b = finite(F.col("r"))
    measures = [
        total_return(b).alias("benchmark_return"),
        sharpe(b, periods, risk_free).alias("benchmark_sharpe"),
    ]
    zero = F.lit(0.0)
    if benchmark_of is not None:
        named = named.join(benchmark_of, list(keys))
        whole = benchmark_of.join(benchmark.groupBy("benchmark").agg(*measures), "benchmark", "left")
        fits = whole.join(beta_alpha(named, benchmark, periods, keys), list(keys), "left").select(
            *keys,
            *[F.coalesce(c, zero).alias(c) for c in ("beta", "alpha", "benchmark_return", "benchmark_sharpe")],
        )
        out = stats.join(fits, list(keys), "left")
    else:
        bench = benchmark.agg(*measures).select(F.struct("*")).scalar()
        fits = beta_alpha(named, benchmark, periods, keys)
        out = stats.join(fits, list(keys), "left").withColumns(
            {
                "beta": F.coalesce("beta", zero),
                "alpha": F.coalesce("alpha", zero),
                "benchmark_return": bench["benchmark_return"],
                "benchmark_sharpe": bench["benchmark_sharpe"],
            }
        )
    return out.withColumn("excess_return", F.col("total_return") - F.col("benchmark_return"))


# -- runs ----------------------------------------------------------------------


def align_benchmark(
    line: DataFrame,
    benchmark: DataFrame,
    names: Sequence[str] = (),
    chunk_seconds: int | None = None,
) -> DataFrame:
    """Benchmark returns ``r`` on the bars of ``line``.

    Prices of other timestamps are dropped before the last known price is carried
    forward; bars before the first price have return 0. With ``names``, these series of
    prices (benchmark, ts, close) are aligned one by one; a name without prices returns 0.
    """
    keys = ["benchmark"] if names else []
    prices = benchmark.select(*keys, "ts", F.col("close").alias("__close"))
    chunk = scans.time_chunk(F.col("ts"), chunk_seconds)
    if names:
        prices = prices.filter(F.col("benchmark").isin(*names))
        line = line.select("*", F.explode(F.array(*map(F.lit, names))).alias("benchmark"))
    filled = scans.running(
        line.join(prices, [*keys, "ts"], "left"),
        keys,
        ["ts"],
        chunk,
        close=scans.last_known(F.col("__close")),
    ).drop("__close")
    paired = scans.previous(filled, keys, ["ts"], chunk, F.col("close"), "__before")
    r = F.coalesce(F.try_divide(F.col("close"), F.col("__before")) - 1, F.lit(0.0))
    return paired.withColumn("r", r).drop("__before")


def exposure(holdings: DataFrame) -> DataFrame:
    """Gross and net weight per run and bar."""
    return holdings.groupBy("run_id", "ts").agg(
        F.sum(F.abs("weight")).alias("gross_exposure"), F.sum("weight").alias("net_exposure")
    )


def turnover(fills: DataFrame, equity: DataFrame) -> DataFrame:
    """Traded amount per bar as a share of equity, 0 without fills."""
    traded = fills.groupBy("run_id", "ts").agg(
        F.sum(F.abs("shares") * F.col("price")).alias("__traded")
    )
    share = F.coalesce(F.try_divide(F.col("__traded"), F.col("equity")), F.lit(0.0))
    return (
        equity.join(traded, ["run_id", "ts"], "left")
        .withColumn("turnover", share)
        .drop("__traded")
    )


def run_stats(equity_table: DataFrame, fills: DataFrame) -> DataFrame:
    """Trades, costs, average turnover and final equity of each run."""
    costs = fills.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("double").alias("trades"),
        F.sum("commission").alias("total_commission"),
        F.sum("slippage_cost").alias("total_slippage"),
    )
    ends = equity_table.groupBy("run_id").agg(
        F.avg("turnover").alias("avg_turnover"), F.max_by("equity", "ts").alias("final_equity")
    )
    zero = F.lit(0.0)
    return ends.join(costs, "run_id", "left").select(
        "run_id",
        F.coalesce("trades", zero).alias("trades"),
        "avg_turnover",
        F.coalesce("total_commission", zero).alias("total_commission"),
        F.coalesce("total_slippage", zero).alias("total_slippage"),
        "final_equity",
    )
