"""Causal indicators per symbol.

All of them work on bars that carry ``seq``. A missing bar is a missing cell of
the panel: a window that contains one yields NULL. Ordering by ``seq`` with range
frames gives that result on the sparse rows, so the dense panel is not built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebar.operators import scans

DEFAULT_CHUNK = 65_536


def _frame(w: WindowSpec, n: int) -> WindowSpec:
    return w.rangeBetween(-(n - 1), 0)


def _previous(name: str, w: WindowSpec) -> Column:
    """Value on the bar just before, NULL if that bar is missing."""
    return F.max(name).over(w.rangeBetween(-1, -1))


def bar_returns(
    panel: DataFrame, name: str = "close", out: str = "r", chunk_rows: int | None = DEFAULT_CHUNK
) -> DataFrame:
    """Simple return from bar to bar, NULL next to a gap."""
    make = lambda w: {out: F.try_divide(F.col(name), _previous(name, w)) - 1}
    return scans.rolling(panel, ["symbol"], "seq", 2, make, chunk_rows)


def sma_expr(name: str, n: int, w: WindowSpec) -> Column:
    f = _frame(w, n)
    return F.when(F.count(name).over(f) == n, F.avg(name).over(f))


def std_expr(name: str, n: int, w: WindowSpec) -> Column:
    f = _frame(w, n)
    return F.when(F.count(name).over(f) == n, F.stddev_samp(name).over(f))


def zscore_expr(name: str, n: int, w: WindowSpec) -> Column:
    f = _frame(w, n)
    # A flat window is told by its extremes: its deviation may be rounding noise.
    flat = F.max(name).over(f) == F.min(name).over(f)
    return F.when(
        ~flat, F.try_divide(F.col(name) - sma_expr(name, n, w), std_expr(name, n, w))
    )


def sma(
    panel: DataFrame,
    windows: Sequence[int],
    name: str = "close",
    chunk_rows: int | None = DEFAULT_CHUNK,
) -> DataFrame:
    """Rolling means ``sma_<n>``; NULL until and unless the window is full."""
    make = lambda w: {f"sma_{n}": sma_expr(name, n, w) for n in windows}
    return scans.rolling(panel, ["symbol"], "seq", max(windows), make, chunk_rows)


def rolling_std(
    panel: DataFrame, n: int, name: str = "close", chunk_rows: int | None = DEFAULT_CHUNK
) -> DataFrame:
    make = lambda w: {f"std_{n}": std_expr(name, n, w)}
    return scans.rolling(panel, ["symbol"], "seq", n, make, chunk_rows)


def zscore(
    panel: DataFrame,
    lookbacks: Sequence[int],
    name: str = "close",
    chunk_rows: int | None = DEFAULT_CHUNK,
) -> DataFrame:
    """``z_<n>``: distance from the rolling mean in rolling deviations."""
    make = lambda w: {f"z_{n}": zscore_expr(name, n, w) for n in lookbacks}
    return scans.rolling(panel, ["symbol"], "seq", max(lookbacks), make, chunk_rows)


def history(
    panel: DataFrame, lookback: int, name: str = "close", chunk_rows: int | None = DEFAULT_CHUNK
) -> DataFrame:
    """Values of the last ``lookback`` bars as ``array<struct<seq, value>>``, oldest first."""

    def make(w: WindowSpec) -> dict[str, Column]:
        item = F.struct("seq", F.col(name).alias("value"))
        return {"history": F.array_sort(F.collect_list(item).over(_frame(w, lookback)))}

    return scans.rolling(panel, ["symbol"], "seq", lookback, make, chunk_rows)


def forward_fill(
    df: DataFrame,
    keys: Sequence[str],
    name: str,
    out: str,
    chunk_seconds: int | None = None,
) -> DataFrame:
    """Last known value of ``name`` in time order."""
    return scans.running(
        df,
        keys,
        ["ts"],
        scans.time_chunk(F.col("ts"), chunk_seconds),
        **{out: scans.last_known(F.col(name))},
    )


def bar_index(panel: DataFrame, warmup: int = 0) -> DataFrame:
    """Add ``can_decide``: warmed up and followed by another bar."""
    last = panel.agg(F.max("seq")).scalar()
    return panel.withColumn("can_decide", (F.col("seq") >= warmup) & (F.col("seq") < last))


def most_oversold(panel: DataFrame, z: str, k: int) -> DataFrame:
    """The ``k`` symbols with the lowest z-score on every bar, ties by symbol."""
    w = Window.partitionBy("seq").orderBy(z, "symbol")
    return (
        panel.filter(F.col(z).isNotNull())
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
    )
