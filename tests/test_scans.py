import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import make_bars, walk
from tidebar.operators import bars, indicators, metrics, scans


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    rows = [
        (k, i, rng.gauss(0, 0.05) if rng.random() > 0.1 else None)
        for k in ("a", "b")
        for i in range(90)
        if rng.random() > 0.2
    ]
    return spark.createDataFrame(rows, "k string, i long, r double")


def both(make, order=("k", "i")):
    whole, cut = make(None), make(F.floor(F.col("i") / 7))
    left = [tuple(r) for r in whole.orderBy(*order).collect()]
    right = [tuple(r) for r in cut.select(*whole.columns).orderBy(*order).collect()]
    assert len(left) == len(right)
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, rel=1e-12) if isinstance(y, float) else y)
    return left


@pytest.mark.parametrize("kind", ["sum", "product", "max", "min", "last"])
def test_running_is_the_same_in_chunks(series, kind):
    value = 1 + F.col("r") if kind == "product" else F.col("r")
    both(lambda c: scans.running(series, ["k"], ["i"], c, out=scans.Running(kind, value)))


def test_previous_crosses_chunks(series):
    got = both(lambda c: scans.previous(series, ["k"], ["i"], c, F.col("r"), "before"))
    assert got[0][-1] is None
    assert got[1][-1] == got[0][2]


def test_streak_crosses_chunks(series):
    flagged = series.withColumn("r", F.when(F.col("i") % 23 == 0, 1.0).otherwise(-1.0))
    got = both(
        lambda c: scans.streak(flagged, ["k"], ["i"], c, F.col("r") > 0, F.lit(True), "n")
    )
    assert max(r[-1] for r in got) > 7


@pytest.mark.parametrize("n", [2, 5, 20])
def test_rolling_is_the_same_in_chunks(spark, n):
    opens, closes = walk(80, 5, gaps=0.05)
    panel = bars.with_seq(make_bars(spark, {"A": closes, "B": walk(80, 6)[1]}))
    whole = indicators.sma(panel, [n], chunk_rows=None).orderBy("symbol", "seq").collect()
    cut = indicators.sma(panel, [n], chunk_rows=6).orderBy("symbol", "seq").collect()
    for a, b in zip([r[f"sma_{n}"] for r in whole], [r[f"sma_{n}"] for r in cut], strict=True):
        assert a == (b if b is None else pytest.approx(b))
    assert any(r[f"sma_{n}"] is not None for r in whole)


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 1.0])
def test_exact_quantile_of_a_large_group_with_many_equal_values(spark, p):
    rng = np.random.default_rng(4)
    values = np.where(rng.random(30_000) < 0.3, 0.0, rng.normal(size=30_000))
    big = spark.createDataFrame([("big", float(v)) for v in values], "run_id string, r double")
    small = spark.createDataFrame([("small", float(v)) for v in values[:17]], big.schema)
    got = {
        r.run_id: r.q
        for r in scans.exact_quantile(big.union(small), ["run_id"], "r", p, "q").collect()
    }
    assert got["big"] == pytest.approx(np.quantile(values, p), abs=1e-14)
    assert got["small"] == pytest.approx(np.quantile(values[:17], p), abs=1e-14)


@pytest.mark.parametrize("cells,small", [(4, 50), (256, 1000)])
def test_quantile_by_repeated_splitting(spark, monkeypatch, cells, small):
    """Many rounds, keys of all sizes and shapes, nulls, and the mean up to the quantile."""
    monkeypatch.setattr(scans, "CELLS", cells)
    monkeypatch.setattr(scans, "SMALL", small)
    rng = np.random.default_rng(9)
    groups = {
        "wide": rng.normal(size=20_000) * 10.0 ** rng.integers(-9, 9, 20_000),
        "ties": np.round(rng.normal(size=8_000), 1),
        "heavy": np.where(rng.random(9_000) < 0.9, 1.5, rng.normal(size=9_000)),
        "one": np.full(5_000, -2.0),
        "two": np.array([3.0, 1.0]),
        "single": np.array([7.0]),
    }
    rows = [(k, float(x)) for k, values in groups.items() for x in values] + [("wide", None), ("none", None)]
    df = spark.createDataFrame(rows, "run_id string, r double").repartition(5)
    for p in (0.0, 0.05, 0.5, 1.0):
        found = scans.exact_quantile(df, ["run_id"], "r", p, "q", "m")
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r.run_id: r for r in found.collect()}
        assert got.keys() == groups.keys()
        for k, values in groups.items():
            q = np.quantile(values, p)
            assert got[k].q == pytest.approx(q, rel=1e-12, abs=1e-14)
            assert got[k].m == pytest.approx(values[values <= got[k].q].mean(), rel=1e-9, abs=1e-12)
    assert scans.exact_quantile(df.filter("false"), ["run_id"], "r", 0.5, "q").count() == 0


def test_timeline_positions(spark):
    frame = make_bars(spark, {"A": [1.0] * 70})
    line = scans.timeline(frame, chunk_seconds=5 * 86400).orderBy("ts").collect()
    assert [r.seq for r in line] == list(range(70))


@pytest.mark.parametrize("chunk_rows", [4, 1000])
def test_dense_grid_fills_every_cell(spark, chunk_rows):
    a = [None, 10.0, None, None, 11.0, 12.0, None, None, None, 13.0, None, None]
    b = [5.0] * 12
    frame = make_bars(spark, {"A": a, "B": b}, {"A": a, "B": b})
    grid = bars.dense_grid(frame, chunk_rows, ("open", "close"))
    got = {(r.symbol, r.seq): r for r in grid.collect()}
    assert len(got) == 24
    mark = None
    for i, close in enumerate(a):
        row = got["A", i]
        assert (row.close, row.prev_mark) == (close, mark)
        mark = close if close is not None else mark
        assert row.mark == mark


def test_drawdown_in_chunks_with_total_losses(spark):
    values = [0.1, -0.3, 0.2, -1.5, 0.3, 0.4, -0.2, -1.2, 0.1, 0.5, 0.2, -0.1]
    frame = make_bars(spark, {"A": [1.0] * len(values)}).select("ts").orderBy("ts")
    rows = [("x", r.ts, v) for r, v in zip(frame.collect(), values)]
    returns = spark.createDataFrame(rows, "run_id string, ts timestamp, r double")
    whole = metrics.return_drawdown(returns).orderBy("ts").collect()
    cut = metrics.return_drawdown(returns, chunk_seconds=3 * 86400).orderBy("ts").collect()
    for a, b in zip(whole, cut):
        assert (a.growth, a.drawdown) == pytest.approx((b.growth, b.drawdown))
