"""Instants and wall clocks, independent of the session time zone.

``from_utc_timestamp`` and ``to_utc_timestamp`` look their zone up once per task, but
fit wall clocks only in a UTC session. ``convert_timezone`` is right in every session
and looks zones up per row. The session decides which one is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidebar.schemas import MARKET_TZ

_UTC_NAMES = {"UTC", "ETC/UTC", "Z", "GMT", "UTC+0", "+00:00"}


def _utc_session() -> bool:
    zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
    return zone.upper() in _UTC_NAMES


def in_zone(ts: Column, tz: str = MARKET_TZ) -> Column:
    """Wall-clock time (``TIMESTAMP_NTZ``) of an instant in ``tz``."""
    if _utc_session():
        shifted = ts if tz == "UTC" else F.from_utc_timestamp(ts, tz)
        return shifted.cast("timestamp_ntz")
    return F.convert_timezone(None, F.lit(tz), ts.cast("timestamp_ntz"))


def from_zone(wall: Column, tz: str = MARKET_TZ) -> Column:
    """Instant at which clocks in ``tz`` show ``wall``."""
    if _utc_session():
        instant = wall.cast("timestamp")
        return instant if tz == "UTC" else F.to_utc_timestamp(instant, tz)
    return F.convert_timezone(F.lit(tz), F.current_timezone(), wall).cast("timestamp")


def from_utc(wall: Column) -> Column:
    return from_zone(wall, "UTC")


def utc_clock(ts: Column) -> Column:
    return in_zone(ts, "UTC")


def market_date(ts: Column, tz: str = MARKET_TZ) -> Column:
    return F.to_date(in_zone(ts, tz))


def utc_date(ts: Column) -> Column:
    return F.to_date(utc_clock(ts))


def minute_of_day(ts: Column, tz: str = MARKET_TZ) -> Column:
    wall = in_zone(ts, tz)
    return F.hour(wall) * 60 + F.minute(wall)
