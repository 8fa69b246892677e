"""Bars ready for use: what a bar table lacks is fetched, merged and cut to size."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from tidebar.operators import bars as bar_ops
from tidebar.operators import coverage as cov
from tidebar.sources.store import BarStore


def load_bars(
    store: BarStore,
    timeframe: str,
    symbols: Iterable[str],
    start: dt.date,
    end: dt.date,
    session: str = "regular",
    fetch: Callable[[DataFrame], DataFrame] | None = None,
    last_settled: dt.date | None = None,
) -> DataFrame:
    """Bars of ``symbols`` between two market dates, both included.

    ``fetch`` gets the windows ``symbol, gap_start, gap_end`` that the table does not cover and
    returns their bars; without it only stored bars are read. No symbols and no bars
    are errors.
    """
    names = sorted({s.strip().upper() for s in symbols} - {""})
    if not names:
        raise ValueError("no symbols given")
    wanted = store.spark.createDataFrame(
        [(n, start, end) for n in names], "symbol string, start date, end date"
    )
    gaps = cov.coverage_gaps(wanted, store.read_coverage(timeframe))
    if fetch is not None and not gaps.isEmpty():
        windows = gaps.selectExpr("symbol", "gap_start AS start", "gap_end AS end")
        store.load(timeframe, fetch(gaps), windows, last_settled)
    found = bar_ops.between_dates(store.read(timeframe, names, start, end), start, end)
    found = bar_ops.filter_session(found, timeframe, session, store.asset_class)
    return bar_ops.require_rows(found, f"{', '.join(names[:20])} from {start} to {end}")
