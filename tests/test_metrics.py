import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import day
from tidebar.operators import metrics

SCHEMA = "run_id string, ts timestamp, r double"


def series(spark, **runs):
    rows = [(k, day(i), v) for k, values in runs.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def stats(spark, values, **kw):
    return metrics.performance_stats(series(spark, x=values), **kw).first()


def test_compounding_and_drawdown(spark):
    assert stats(spark, [0.1, 0.1]).total_return == pytest.approx(0.21)
    assert stats(spark, [1.0, -0.5]).max_drawdown == pytest.approx(-0.5)
    assert stats(spark, [0.1, -0.05, -0.05, 0.2, 0.0]).max_drawdown_bars == 2
    assert stats(spark, [-0.5, 0.1]).max_drawdown == pytest.approx(0.0)


def test_ratios(spark):
    one = stats(spark, [0.02, -0.01, 0.01, -0.01])
    assert one.profit_factor == pytest.approx(1.5)
    assert one.win_rate == pytest.approx(0.5)
    assert stats(spark, [0.01, 0.02, 0.03]).sortino == math.inf
    assert stats(spark, [0.01, 0.02]).profit_factor == math.inf
    flat = stats(spark, [0.01] * 30)
    assert (flat.sharpe, flat.calmar) == (0.0, 0.0)
    assert stats(spark, [0.01, 0.0, 0.0]).win_rate == 1.0
    assert stats(spark, [0.01]).volatility == 0.0


def test_tail(spark):
    values = [math.sin(i * 1.7) / 50 for i in range(200)]
    got = stats(spark, values)
    assert got.cvar_95 <= got.var_95 < 0


def test_missing_and_infinite_returns_do_not_count(spark):
    got = stats(spark, [0.1, None, math.inf, float("nan"), -0.05, -0.05, None, 0.0])
    assert got.periods == 4
    assert got.max_drawdown_bars == 3
    assert got.total_return == pytest.approx(1.1 * 0.95 * 0.95 - 1)


def test_a_run_without_returns_has_zero_statistics(spark):
    got = stats(spark, [None, None])
    assert (got.periods, got.total_return, got.cagr, got.var_95, got.max_drawdown) == (0, 0, 0, 0, 0)


def test_beta(spark):
    values = [0.01, -0.02, 0.015, 0.003, -0.007]
    bench = series(spark, b=values).select("ts", "r")
    runs = series(spark, same=values, double=[2 * v for v in values])
    got = {r.run_id: r for r in metrics.beta_alpha(runs, bench, 252).collect()}
    assert got["same"].beta == pytest.approx(1)
    assert got["double"].beta == pytest.approx(2)
    assert got["double"].alpha == pytest.approx(0, abs=1e-12)


def test_benchmark_is_taken_at_shared_timestamps_only(spark):
    line = spark.createDataFrame([(day(i),) for i in (0, 2, 3, 5)], "ts timestamp")
    prices = [(day(0), 10.0), (day(1), 99.0), (day(3), 11.0)]
    bench = spark.createDataFrame(prices, "ts timestamp, close double")
    for chunk in (None, 2 * 86400):
        got = metrics.align_benchmark(line, bench, chunk_seconds=chunk).orderBy("ts").collect()
        assert [r.close for r in got] == [10, 10, 11, 11]
        assert [r.r for r in got] == pytest.approx([0, 0, 0.1, 0])


def test_chunks_give_the_same_statistics(spark):
    values = [math.sin(i * 1.3) / 20 if i % 9 else None for i in range(150)]
    returns = series(spark, a=values, b=[-(v or 0.0) for v in values])
    whole = metrics.performance_stats(returns, chunk_seconds=None).orderBy("run_id").collect()
    cut = metrics.performance_stats(returns, chunk_seconds=11 * 86400).orderBy("run_id").collect()
    for a, b in zip(whole, cut):
        assert a[0] == b[0]
        assert tuple(a)[1:] == pytest.approx(tuple(b)[1:], rel=1e-9)
