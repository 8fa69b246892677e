import datetime as dt
import random

import pytest

from tidebar.session import local_session

UTC = dt.timezone.utc


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", app="tidebar-tests", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(i, start=dt.datetime(2024, 1, 2, 5, tzinfo=UTC)):
    return start + dt.timedelta(days=i)


BARS_SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, trade_count double, vwap double"


def make_bars(spark, closes, opens=None):
    """Bars from ``{symbol: [close or None, ...]}``; a missing bar is None in both."""
    rows = []
    for symbol, values in closes.items():
        before = None
        for i, close in enumerate(values):
            first = opens[symbol][i] if opens else (before if before is not None else close)
            if close is None and first is None:
                continue
            known = [v for v in (first, close) if v is not None]
            rows.append(
                (symbol, day(i), first, max(known), min(known), close, 1e6, 1e3, sum(known) / len(known))
            )
            before = close if close is not None else before
    return spark.createDataFrame(rows, BARS_SCHEMA)


def walk(n, seed, step=0.02, start=100.0, gaps=0.0):
    rng = random.Random(seed)
    opens, closes, price = [], [], start
    for _ in range(n):
        o = price * (1 + rng.gauss(0, step / 2))
        price = o * (1 + rng.gauss(0, step))
        if rng.random() < gaps:
            opens.append(None)
            closes.append(None)
        else:
            opens.append(o)
            closes.append(price)
    return opens, closes
