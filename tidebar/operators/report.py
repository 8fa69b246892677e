"""Result rows in display form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How each statistic is shown.
PERCENT_KEYS = [
    "total_return",
    "cagr",
    "volatility",
    "max_drawdown",
    "win_rate",
    "var_95",
    "cvar_95",
    "best_period",
    "worst_period",
    "avg_turnover",
    "alpha",
    "benchmark_return",
    "excess_return",
]
DOLLAR_KEYS = ["total_commission", "total_slippage", "final_equity"]


def stats_long(stats: DataFrame) -> DataFrame:
    """One row per run and statistic: ``run_id, metric, value``."""
    names = [c for c in stats.columns if c != "run_id"]
    return stats.unpivot("run_id", names, "metric", "value")


def _grouped(x: Column, digits: int) -> Column:
    return F.format_number(x, digits)


def display_value(metric: Column, value: Column) -> Column:
    whole = (value == F.floor(value)) & (F.abs(value) < 1e9)
    return (
        F.when(value.isNull(), "N/A")
        .when(F.abs(value) == float("inf"), "∞")
        .when(metric.isin(PERCENT_KEYS), F.concat(_grouped(value * 100, 2), F.lit("%")))
        .when(metric.isin(DOLLAR_KEYS), F.concat(F.lit("$"), _grouped(value, 2)))
        .when(whole, _grouped(value, 0))
        .otherwise(_grouped(value, 4))
    )


def format_stats(stats: DataFrame) -> DataFrame:
    """Statistics as text: ``run_id, metric, shown``."""
    return stats_long(stats).select(
        "run_id",
        F.replace("metric", F.lit("_"), F.lit(" ")).alias("metric"),
        display_value(F.col("metric"), F.col("value")).alias("shown"),
    )


def last_fills(fills: DataFrame, n: int = 10) -> DataFrame:
    """The latest ``n`` fills, ties by run and symbol."""
    return fills.orderBy(F.desc("ts"), F.desc("run_id"), F.desc("symbol")).limit(n)
