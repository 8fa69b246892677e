"""Joins whose keys may hold a large part of all rows, and joins that most rows need not enter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with more than one in ``SHARE`` of all rows are hot, so there are fewer than that many.
SHARE = 1000
LEAST = 100


def lookup(rows: DataFrame, table: DataFrame, key: str, total: int, size: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key and counts its ``rows``.

    ``total`` is the number of ``rows``. Keys with more than ``total / SHARE`` rows (and ``LEAST``)
    are fewer than ``SHARE``, whatever the size of the tables: that part of ``table`` is broadcast and
    its rows stay where they are. The others meet by a shuffle, in which no key has more rows
    than that. Null keys find nothing.
    """
    limit = max(LEAST, total // SHARE)
    hot, rest = table.filter(F.col(size) > limit), table.filter(F.col(size) <= limit)
    named = F.broadcast(hot.select(key))
    found = rows.join(F.broadcast(hot.drop(size)), key)
    return found.unionByName(rows.join(named, key, "left_anti").join(rest.drop(size), key))


#: Bits of a bitmap per key, and in all: 64 MB at most are broadcast.
BITS_PER_KEY = 16
MOST_BITS = 1 << 29
_ROW_BITS = 1 << 15  # of one row of the table of bitmaps


def maybe_in(rows: DataFrame, key: Column, members: DataFrame, member: Column) -> DataFrame:
    """``rows`` with a boolean ``hit``: false where ``key`` is surely not among ``members``.

    Bitmaps of hashed keys are built by an aggregation and broadcast, ``MOST_BITS`` at most,
    whatever the number of members; with more members than those bits serve, more rows hit. So rows
    that need no look at ``members`` are told apart without a shuffle.
    """
    bits = _ROW_BITS
    wanted = BITS_PER_KEY * members.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(17)), F.lit(bits))
    at = F.pmod("__place", F.lit(_ROW_BITS))
    row = F.floor(F.col("__place") / _ROW_BITS).alias("__row")
    maps = members.select(place(member).alias("__place")).select(row, at.alias("__at")).groupBy("__row").agg(
        F.bitmap_construct_agg("__at").alias("__map"))
    octet = F.substring(F.col("__map"), F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(octet), 16, 10).cast("int")
    hit = F.getbit(F.coalesce(value, F.lit(0)), F.pmod("__at", F.lit(8)).cast("int")) == 1
    whole = rows.select(F.struct("*").alias("__whole"), place(key).alias("__place"))
    placed = whole.select("__whole", row, at.alias("__at"))
    found = placed.join(F.broadcast(maps), "__row", "left")
    return found.select("__whole.*", F.coalesce(hit, F.lit(False)).alias("hit"))
