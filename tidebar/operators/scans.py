"""Running and rolling values over long ordered series.

A plain ``Window.partitionBy(key)`` puts the whole series of a key into one
task. Here a series is cut into chunks, every chunk is a task of bounded size,
and only one small row per chunk crosses over to the next ones:

* :func:`running` - running sums, products, extremes and last values. Each chunk
  is scanned on its own and combined with the totals of the chunks before it.
* :func:`rolling` - frames over the last N positions. The N-1 rows before a
  chunk are copied into it, which is exact for every N.

With ``chunk=None`` both fall back to an ordinary window over the key, which is
right for series whose length is bounded anyway (daily bars).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebar.session import durable

CHUNK = "__chunk"


@dataclass(frozen=True)
class Running:
    """A running aggregate: how one chunk is summed up and carried on."""

    kind: str
    value: Column

    def local(self, w: WindowSpec) -> Column:
        if self.kind == "last":
            return F.last(self.value, ignorenulls=True).over(w)
        return _AGGREGATES[self.kind](self.value).over(w)

    def total(self, order: Sequence[str]) -> Column:
        if self.kind == "last":
            at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
            return F.max_by(self.value, F.when(self.value.isNotNull(), at))
        return _AGGREGATES[self.kind](self.value)

    def carried(self, total: Column, before: WindowSpec) -> Column:
        if self.kind == "last":
            return F.last(total, ignorenulls=True).over(before)
        return _AGGREGATES[self.kind](total).over(before)

    def combine(self, carry: Column, local: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(carry + local, local, carry)
        if self.kind == "product":
            return F.coalesce(carry * local, local, carry)
        if self.kind == "max":
            return F.greatest(carry, local)
        if self.kind == "min":
            return F.least(carry, local)
        return F.coalesce(local, carry)


_AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "product": F.product,
    "max": F.max,
    "min": F.min,
}


def running_sum(value: Column) -> Running:
    return Running("sum", value)


def running_product(value: Column) -> Running:
    return Running("product", value)


def running_max(value: Column) -> Running:
    return Running("max", value)


def running_min(value: Column) -> Running:
    return Running("min", value)


def last_known(value: Column) -> Running:
    return Running("last", value)


def row_count() -> Running:
    return Running("sum", F.lit(1).cast("long"))


def time_chunk(ts: Column, seconds: int | None) -> Column | None:
    """Chunk number of an instant; ``None`` keeps series whole."""
    if seconds is None:
        return None
    return F.floor(F.unix_seconds(ts) / F.lit(seconds)).cast("long")


def never_null(chunk: Column) -> Column:
    """Spares the joins on chunks a test for NULL, so both sides can share a shuffle."""
    return F.coalesce(chunk.cast("long"), F.lit(0).cast("long"))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None,
    **values: Running,
) -> DataFrame:
    """Add one running column per entry of ``values``, current row included.

    ``chunk`` must not decrease along ``order``.
    """
    if chunk is None:
        w = (
            Window.partitionBy(*keys)
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return df.select("*", *[v.local(w).alias(n) for n, v in values.items()])

    marked = df.withColumn(CHUNK, never_null(chunk))
    at = [*keys, CHUNK]
    inside = (
        Window.partitionBy(*at)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = (
        marked.groupBy(*at)
        .agg(*[v.total(order).alias(f"__t_{n}") for n, v in values.items()])
        .select(
            *at,
            *[v.carried(F.col(f"__t_{n}"), before).alias(f"__c_{n}") for n, v in values.items()],
        )
    )
    local = marked.select("*", *[v.local(inside).alias(f"__l_{n}") for n, v in values.items()])
    return local.join(carries, at).select(
        *[F.col(c) for c in df.columns],
        *[
            v.combine(F.col(f"__c_{n}"), F.col(f"__l_{n}")).alias(n)
            for n, v in values.items()
        ],
    )


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    rows: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    chunk_rows: int | None,
) -> DataFrame:
    """Add columns computed over the last ``rows`` positions.

    ``columns`` receives the partitioning and ordering and sets its own frames,
    none of which may reach back further than ``rows`` positions. ``position``
    is the integer place of a row on the timeline, so a missing row counts as a
    missing cell.
    """
    if chunk_rows is None:
        w = Window.partitionBy(*keys).orderBy(position)
        return df.withColumns(columns(w))
    own = F.floor(F.col(position) / chunk_rows)
    reach = F.floor((F.col(position) + (rows - 1)) / chunk_rows)
    spread = df.select("*", F.explode(F.sequence(own, reach)).alias(CHUNK))
    w = Window.partitionBy(*keys, CHUNK).orderBy(position)
    return spread.withColumns(columns(w)).filter(F.col(CHUNK) == own).drop(CHUNK)


def timeline(bars: DataFrame, chunk_seconds: int = 30 * 86400) -> DataFrame:
    """Distinct timestamps with their 0-based position: ``ts, seq``.

    The table is small and read many times by what is built on it, so it is written
    once instead of being worked out again in every branch of a plan.
    """
    stamps = bars.select("ts").distinct()
    counted = running(
        stamps, [], ["ts"], time_chunk(F.col("ts"), chunk_seconds), seq=row_count()
    )
    return durable(counted.select("ts", (F.col("seq") - 1).alias("seq")))


#: Splits of a bracket per round, and how many values of a key are picked from at once.
CELLS = 256
SMALL = 10_000


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, p: float, out: str, mean_upto: str | None = None
) -> DataFrame:
    """Exact quantile with linear interpolation, one row per key; with ``mean_upto`` also the
    mean of the values up to it.

    A bracket around the wanted ranks shrinks round by round. A round counts what lies below and
    inside and splits the inside into ``CELLS`` ranges by a sketch, whose counts are
    checked by the next round; only counts, sums and sketches are shuffled. Once a key has at most ``SMALL`` values
    inside (or ties that no split takes apart), its different values are picked from by their counts.
    """
    rows = durable(df.select(*keys, F.col(value).alias("__v")).filter(F.col(value).isNotNull()))
    v, grid = F.col("__v"), [i / CELLS for i in range(CELLS + 1)]
    split = lambda c: F.percentile_approx(c, grid, 20 * CELLS)
    state = durable(
        rows.groupBy(*keys).agg(
            F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), split(v).alias("cells")
        ).select(
            *keys, "n", "low", "high", F.lit(0).cast("long").alias("below"),
            F.lit(0.0).alias("total"), F.col("n").alias("inside"), (F.col("n") > SMALL).alias("open"), "cells",
        )
    )
    first, last = F.floor(F.lit(p) * (F.col("n") - 1)), F.ceil(F.lit(p) * (F.col("n") - 1))
    while not state.filter("open").isEmpty():
        # Cells that hold both ranks, and one more on either side for the sketch's error.
        cell = lambda rank: (rank - F.col("below")) * CELLS / F.greatest(F.col("inside"), F.lit(1))
        at = F.greatest(F.floor(cell(first)) - 1, F.lit(0)).cast("int")
        to = F.least(F.ceil(cell(last + 1)) + 1, F.lit(CELLS)).cast("int")
        tried = state.filter("open").select(
            *keys, "n", "low", "high", "below", "total", "inside",
            F.get("cells", at).alias("from"), F.get("cells", to).alias("to"),
        )
        within = v.between(F.col("from"), F.col("to"))
        found = (
            rows.join(tried.select(*keys, "from", "to"), list(keys)).filter(v <= F.col("to"))
            .groupBy(*keys).agg(
                F.count_if(v < F.col("from")).alias("b"),
                F.coalesce(F.sum(F.when(v < F.col("from"), v)), F.lit(0.0)).alias("t"),
                F.count_if(within).alias("i"),
                split(F.when(within, v)).alias("c"),
            )
        )
        # A bracket that misses a rank, which only a sketch beyond its error gives, is not taken;
        # one that did not halve holds ties, fewer than CELLS values of which make up most of it.
        holds = F.coalesce((F.col("b") <= first) & (last < F.col("b") + F.col("i")), F.lit(False))
        halved = holds & (F.col("i") > SMALL) & (2 * F.col("i") <= F.col("inside"))
        kept = {"low": "from", "high": "to", "below": "b", "total": "t", "inside": "i"}
        shrunk = tried.join(found, list(keys), "left").select(
            *keys, "n", *[F.when(holds, F.col(new)).otherwise(F.col(old)).alias(old) for old, new in kept.items()],
            halved.alias("open"), F.col("c").alias("cells"),
        )
        state = durable(state.filter("NOT open").unionByName(shrunk))
    near = (
        rows.join(state.select(*keys, "low", "high"), list(keys))
        .filter(v.between(F.col("low"), F.col("high")))
        .groupBy(*keys, "__v").agg(F.count("*").alias("__k"))
    )
    picked = near.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__v", "__k"))).alias("values"))
    start = F.struct(
        F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("lower"),
        F.lit(None).cast("double").alias("upper"),
    )

    def step(seen: Column, e: Column) -> Column:
        upto = seen["upto"] + e["__k"]
        here = F.col("below") + upto
        known = e["__v"].cast("double")
        return F.struct(
            upto.alias("upto"),
            F.coalesce(seen["lower"], F.when(here > first, known)).alias("lower"),
            F.coalesce(seen["upper"], F.when(here > last, known)).alias("upper"),
        )

    ranked = picked.join(state.select(*keys, "n", "below", "total"), list(keys)).withColumn(
        "__r", F.aggregate("values", start, step)
    )
    share = F.lit(p) * (F.col("n") - 1) - first
    quantile = F.col("__r.lower") + (F.col("__r.upper") - F.col("__r.lower")) * share
    if mean_upto is not None:
        upto = F.filter("values", lambda e: e["__v"] <= F.col(out))
        count = F.aggregate(upto, F.col("below"), lambda t, e: t + e["__k"])
        total = F.aggregate(upto, F.col("total"), lambda t, e: t + e["__v"] * e["__k"])
        named = ranked.withColumn(out, quantile)
        return named.select(*keys, out, F.try_divide(total, count).alias(mean_upto))
    return ranked.select(*keys, quantile.alias(out))


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None,
    value: Column,
    out: str,
) -> DataFrame:
    """Value on the row before, across chunk borders too."""
    named = df.withColumn("__v", value)
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return named.withColumn(out, F.lag("__v").over(w)).drop("__v")
    marked = named.withColumn(CHUNK, never_null(chunk))
    at = [*keys, CHUNK]
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    ends = (
        marked.groupBy(*at)
        .agg(F.max_by(F.struct("__v"), place).alias("__end"))
        .select(
            *at, F.lag("__end").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("__end")
        )
    )
    w = Window.partitionBy(*at).orderBy(*order)
    return (
        marked.withColumns({"__n": F.row_number().over(w), "__lag": F.lag("__v").over(w)})
        .join(ends, at)
        .select(
            *df.columns,
            F.when(F.col("__n") == 1, F.col("__end.__v")).otherwise(F.col("__lag")).alias(out),
        )
    )


def streak(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None,
    breaks: Column,
    counts: Column,
    out: str,
) -> DataFrame:
    """Number of counted rows since the last row on which ``breaks`` holds.

    Chunks are summed up by their number of rows and the place of their last
    break, from which the part of a streak that began earlier follows.
    """
    whole = chunk is None
    marked = df.withColumn(CHUNK, F.lit(0) if whole else never_null(chunk)).withColumn(
        "__b", breaks
    )
    at = list(keys) if whole else [*keys, CHUNK]
    upto = (
        Window.partitionBy(*at)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = marked.withColumn(
        "__n", F.sum(F.when(counts, 1).otherwise(0)).over(upto)
    ).withColumn("__last", F.max(F.when(F.col("__b"), F.col("__n"))).over(upto))
    if whole:
        run = F.col("__n") - F.coalesce("__last", F.lit(0))
        return placed.select(*df.columns, run.alias(out))
    before = (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = placed.groupBy(*at).agg(
        F.max("__n").alias("__rows"), F.max("__last").alias("__stop")
    )
    ends = (
        ends.withColumn("__past", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        .withColumn(
            "__open",
            F.col("__past")
            - F.coalesce(
                F.last(F.col("__past") + F.col("__stop"), ignorenulls=True).over(before),
                F.lit(0),
            ),
        )
        .select(*at, "__open")
    )
    run = F.when(F.col("__last").isNotNull(), F.col("__n") - F.col("__last")).otherwise(
        F.col("__open") + F.col("__n")
    )
    return placed.join(ends, at).select(*df.columns, run.alias(out))
