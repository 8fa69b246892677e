"""Signals: from bars to target weights.

A signal takes the panel (bars with ``seq``), the runs that use it and the number
of bars, and returns

* ``weights[run_id, seq, symbol, weight]`` - targets decided at the close of ``seq``,
* ``decisions[run_id, seq, is_hold]`` - one row per bar on which a run decides.

A decision without weights means "go flat", ``is_hold`` means "change nothing".
Indicators are computed once per distinct parameter and only then spread over the
runs that share them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.operators import indicators, scans
from tidebar.session import durable


@dataclass(frozen=True)
class Costs:
    """Trading and financing costs; the rates are annual."""

    slippage_bps: float = 1.0
    commission_per_share: float = 0.0
    commission_bps: float = 0.0
    min_commission: float = 0.0
    cash_rate: float = 0.0
    borrow_rate: float = 0.0


@dataclass(frozen=True)
class Run:
    """One row of a sweep: a signal, its parameters, its account and what it is compared with."""

    run_id: str
    signal: str
    params: dict[str, Any] = field(default_factory=dict)
    costs: Costs = Costs()
    initial_cash: float = 100_000.0
    max_leverage: float = 1.0
    benchmark: str | None = None


class Signal(NamedTuple):
    """Targets and decisions of some runs, and the bars each needs before it decides (0 if not given)."""

    weights: DataFrame
    decisions: DataFrame
    warmups: dict[str, int] = {}


SignalFunction = Callable[[DataFrame, Sequence[Run], "Column | int"], Signal]
_signals: dict[str, SignalFunction] = {}


def register(name: str) -> Callable[[SignalFunction], SignalFunction]:
    def add(function: SignalFunction) -> SignalFunction:
        _signals[name.lower()] = function
        return function

    return add


def list_signals() -> list[str]:
    return sorted(_signals)


def get_signal(name: str) -> SignalFunction:
    found = _signals.get(name.lower())
    if found is None:
        raise KeyError(f"no signal {name!r}; there are {', '.join(list_signals())}")
    return found


_RELATIVE = 1e-9


def compared_prefixes(
    panel: DataFrame, runs: Sequence[Run], length: int, cuts: Sequence[int]
) -> DataFrame:
    """What runs decide before each cut, with all bars and with a changed future, side by side.

    For every cut the signal sees the panel up to bar ``cut``, in which that last bar has its numbers
    multiplied or divided by four by symbol, as if the market had gone another way. What
    it decides up to the bar before must be the same. Rows are run_id, cut, seq, symbol (NULL for the
    decision itself), ``whole``, ``cut_off`` (weights, or 1 for a hold) and ``differs``; a decision
    or weight that is on one side only differs, weights do beyond rounding.
    """
    spoiled = [c for c, kind in panel.dtypes if kind == "double"]
    bad = [c for c in cuts if not 0 < c < length]
    if bad or not cuts:
        raise ValueError(f"cuts must lie within the {length} bars, got {list(cuts)}")
    whole = _decided(panel, runs, length).withColumn("cut", F.explode(F.array(*map(F.lit, cuts))))
    sides = [whole.withColumn("side", F.lit(0))]
    for cut in cuts:
        way = F.pow(F.lit(4.0), 1 - 2 * F.pmod(F.xxhash64("symbol", F.lit(cut)), F.lit(2)))
        factor = F.when(F.col("seq") == cut, way).otherwise(1.0)
        changed = panel.filter(F.col("seq") <= cut).withColumns({c: F.col(c) * factor for c in spoiled})
        made = _decided(changed, runs, cut + 1)
        sides.append(made.withColumns({"cut": F.lit(cut), "side": F.lit(1)}))
    pairs = (
        _union(sides)
        .filter(F.col("seq") < F.col("cut"))
        .groupBy("run_id", "cut", "seq", "symbol")
        .agg(
            *[
                F.sum(F.when(F.col("side") == side, F.col("value"))).alias(name)
                for side, name in enumerate(("whole", "cut_off"))
            ]
        )
    )
    bound = F.lit(_RELATIVE) * F.greatest(F.abs("whole"), F.abs("cut_off"))
    same = F.abs(F.col("whole") - F.col("cut_off")) <= bound
    return pairs.withColumn("differs", ~F.coalesce(same, F.lit(False)))


def _decided(panel: DataFrame, runs: Sequence[Run], length: int) -> DataFrame:
    """Weights and decisions of runs of any signals as rows of one kind."""
    groups: dict[str, list[Run]] = {}
    for run in runs:
        groups.setdefault(run.signal, []).append(run)
    rows = []
    for name, members in groups.items():
        made = get_signal(name)(panel, members, length)
        rows.append(made.weights.select("run_id", "seq", "symbol", F.col("weight").alias("value")))
        held = F.col("is_hold").cast("double").alias("value")
        rows.append(made.decisions.select("run_id", "seq", F.lit(None).cast("string").alias("symbol"), held))
    return _union(rows)


def require_causal(
    panel: DataFrame, runs: Sequence[Run], length: int, cuts: Sequence[int] = ()
) -> None:
    """Raise if a run decides otherwise once later bars are cut off and changed.

    Without ``cuts`` three are spread over the bars. A difference proves that a signal looks
    ahead; that none is found does not prove the contrary, so give more cuts to be surer.
    """
    cuts = cuts or sorted({length * k // 4 for k in (1, 2, 3)} - {0})
    found = compared_prefixes(panel, runs, length, cuts).filter("differs")
    first = found.groupBy("run_id").agg(F.min("seq").alias("seq")).orderBy("run_id").limit(20).collect()
    if first:
        ahead = ", ".join(f"{r.run_id} (bar {r.seq})" for r in first)
        raise ValueError(f"decisions depend on later bars: {ahead}")


def run_label(name: Column, params: Column) -> Column:
    """``Name(a=1, b=2)`` from a map of parameters, sorted by key."""
    pairs = F.transform(
        F.array_sort(F.map_entries(params)),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]),
    )
    return F.when(F.size(pairs) == 0, name).otherwise(
        F.concat(name, F.lit("("), F.array_join(pairs, ", "), F.lit(")"))
    )


def account_frame(spark: SparkSession, runs: Sequence[Run]) -> DataFrame:
    """Parameter table: one row per run with account and cost settings."""
    names = list(Costs.__dataclass_fields__)
    rows = [
        (r.run_id, float(r.initial_cash), float(r.max_leverage))
        + tuple(float(getattr(r.costs, n)) for n in names)
        for r in runs
    ]
    return spark.createDataFrame(
        rows,
        ", ".join(
            ["run_id string"]
            + [f"{n} double" for n in ["initial_cash", "max_leverage", *names]]
        ),
    )


def _params_frame(spark: SparkSession, runs: Sequence[Run], **kinds: tuple[str, Any]) -> DataFrame:
    """Signal parameters of the runs; ``kinds`` maps a name to (type, default)."""
    cast = {"int": int, "double": float, "boolean": bool}
    rows = [
        (r.run_id,)
        + tuple(cast[kind](r.params.get(name, default)) for name, (kind, default) in kinds.items())
        for r in runs
    ]
    schema = ", ".join(["run_id string"] + [f"{n} {k}" for n, (k, _) in kinds.items()])
    return spark.createDataFrame(rows, schema)


def _count(length: Column | int) -> Column:
    return F.lit(length).cast("long")


def chunk_for(length: Column | int) -> int | None:
    """Chunk size for series of this length; short ones stay whole."""
    limit = indicators.DEFAULT_CHUNK
    return None if isinstance(length, int) and length <= limit else limit


def _every_bar(params: DataFrame, warmup: Column | str, length: Column | int) -> DataFrame:
    """A decision on every bar from ``warmup`` to the last but one."""
    length = _count(length)
    first = F.col(warmup).cast("long") if isinstance(warmup, str) else warmup
    return (
        params.select("run_id", first.alias("__first"), (length - 2).alias("__last"))
        .filter(F.col("__last") >= F.col("__first"))
        .select(
            "run_id",
            F.explode(F.sequence("__first", "__last")).alias("seq"),
            F.lit(False).alias("is_hold"),
        )
    )


def per_run(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Repeat rows for every run of a parameter table.

    The runs are a small table of settings, so they travel inside the row instead
    of being joined.
    """
    table = params.agg(F.collect_list(F.struct(*params.columns))).scalar()
    return rows.select("*", F.explode(table).alias("__run")).select(
        *rows.columns, *[F.col(f"__run.{c}").alias(c) for c in params.columns]
    )


def equal_weight(rows: DataFrame, keys: Sequence[str], gross: Column) -> DataFrame:
    """Share ``gross`` equally among the rows of a group."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("weight", gross / n)


@register("buy_and_hold")
def buy_and_hold(panel: DataFrame, runs: Sequence[Run], length: Column | int) -> Signal:
    """Equal weights over the symbols with a close; once, or on every bar."""
    spark = panel.sparkSession
    priced = panel.filter(F.col("close").isNotNull() & (F.col("seq") < length - 1)).select(
        "seq", "symbol"
    )
    weights, decisions = [], []
    for rebalance in (False, True):
        chosen = [r for r in runs if bool(r.params.get("rebalance", False)) is rebalance]
        if not chosen:
            continue
        params = _params_frame(spark, chosen, gross=("double", 1.0))
        rows = priced
        if not rebalance:
            rows = priced.filter(F.col("seq") == priced.agg(F.min("seq")).scalar())
        shared = equal_weight(rows, ["seq"], F.lit(1.0))
        weights.append(
            per_run(shared, params).select(
                "run_id", "seq", "symbol", (F.col("gross") * F.col("weight")).alias("weight")
            )
        )
        acted = rows.select("seq").distinct().withColumn("acts", F.lit(True))
        every = _every_bar(params, F.lit(0).cast("long"), length).drop("is_hold")
        decisions.append(
            every.join(acted, "seq", "left").select(
                "run_id", "seq", F.col("acts").isNull().alias("is_hold")
            )
        )
    return Signal(_union(weights), _union(decisions))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@register("sma_cross")
def sma_cross(panel: DataFrame, runs: Sequence[Run], length: Column | int) -> Signal:
    """Long while the fast mean is above the slow one, optionally short below."""
    params = _params_frame(
        panel.sparkSession,
        runs,
        fast=("int", 20),
        slow=("int", 100),
        long_short=("boolean", False),
        gross=("double", 1.0),
    )
    pairs = sorted({(int(r.params.get("fast", 20)), int(r.params.get("slow", 100))) for r in runs})
    for fast, slow in pairs:
        if fast >= slow:
            raise ValueError(f"fast ({fast}) must be shorter than slow ({slow})")
    windows = sorted({n for pair in pairs for n in pair})
    means = indicators.sma(
        panel.select("symbol", "seq", "close"), windows, chunk_rows=chunk_for(length)
    )

    def trend(fast: int, slow: int) -> Column:
        f, s = F.col(f"sma_{fast}"), F.col(f"sma_{slow}")
        state = F.when(f > s, 1).when(f <= s, -1)
        return F.struct(F.lit(fast).alias("fast"), F.lit(slow).alias("slow"), state.alias("way"))

    trends = (
        means.filter(F.col("seq") < length - 1)
        .select("symbol", "seq", F.explode(F.array(*[trend(*p) for p in pairs])).alias("t"))
        .select("symbol", "seq", "t.*")
        .filter(F.col("way").isNotNull() & (F.col("seq") >= F.col("slow")))
    )
    shared = equal_weight(trends, ["fast", "slow", "seq", "way"], F.lit(1.0))
    scale = F.when(F.col("long_short"), F.col("gross") / 2 * F.col("way")).otherwise(
        F.col("gross")
    )
    weights = (
        shared.join(params, ["fast", "slow"])
        .filter(F.col("long_short") | (F.col("way") > 0))
        .select("run_id", "seq", "symbol", (F.col("weight") * scale).alias("weight"))
    )
    warmups = {r.run_id: int(r.params.get("slow", 100)) for r in runs}
    return Signal(weights, _every_bar(params, "slow", length), warmups)


# -- mean reversion --------------------------------------------------------------

_LEVELS = ["lookback", "entry_z", "exit_z"]


def _levels(run: Run) -> tuple[int, float, float]:
    return (
        int(run.params.get("lookback", 20)),
        float(run.params.get("entry_z", 1.0)),
        float(run.params.get("exit_z", 0.0)),
    )


def scored(
    panel: DataFrame, levels: Sequence[tuple[int, float, float]], length: Column | int
) -> DataFrame:
    """z-scores on decision bars for each (lookback, entry_z, exit_z)."""
    lookbacks = sorted({lv[0] for lv in levels})
    z = indicators.zscore(
        panel.select("symbol", "seq", "close"), lookbacks, chunk_rows=chunk_for(length)
    )
    item = lambda lv: F.struct(
        F.lit(lv[0]).alias("lookback"),
        F.lit(lv[1]).alias("entry_z"),
        F.lit(lv[2]).alias("exit_z"),
        F.col(f"z_{lv[0]}").alias("z"),
    )
    return (
        z.filter(F.col("seq") < length - 1)
        .select("symbol", "seq", F.explode(F.array(*[item(lv) for lv in sorted(levels)])).alias("s"))
        .select("symbol", "seq", "s.*")
        .filter(F.col("seq") >= F.col("lookback"))
    )


def held_names(
    scores: DataFrame, chunk_rows: int | None = indicators.DEFAULT_CHUNK
) -> DataFrame:
    """Symbols held on each bar when any number of them may be held.

    A name enters below ``-entry_z`` and leaves at ``exit_z``; in between the last
    of these events counts. A missing score releases the name, and so does a
    missing bar, which shows as a step in ``seq``.
    """
    keys = ["symbol", *_LEVELS]
    chunk = None if chunk_rows is None else F.floor(F.col("seq") / chunk_rows)
    stepped = scans.previous(scores, keys, ["seq"], chunk, F.col("seq"), "__prev")
    fresh = F.col("__prev").isNull() | (F.col("__prev") < F.col("seq") - 1)
    event = (
        F.when(F.col("z") < -F.col("entry_z"), 1)
        .when(F.col("z").isNull() | (F.col("z") >= F.col("exit_z")) | fresh, 0)
    )
    state = scans.running(stepped, keys, ["seq"], chunk, held=scans.last_known(event))
    return state.filter(F.col("held") == 1).select("symbol", "seq", *_LEVELS, "z")


def _fold_bars(bars: Column, start: Column) -> Column:
    """Walk through the bars of a chunk; each step yields the names held after it.

    ``bars`` is ``array<struct<seq, room, keep, enter>>`` in time order: ``keep``
    are the symbols a holder would not release, ``enter`` those to buy, most
    oversold first. The accumulator is the list of holdings so far.
    """
    empty = F.array().cast("array<struct<seq:bigint,held:array<string>>>")

    def step(done: Column, bar: Column) -> Column:
        now = F.coalesce(F.try_element_at(done, F.lit(-1))["held"], start)
        kept = F.array_intersect(now, bar["keep"])
        fresh = F.array_except(bar["enter"], kept)
        room = F.greatest(F.lit(0), bar["room"] - F.size(kept))
        held = F.concat(kept, F.slice(fresh, F.lit(1), room))
        return F.concat(done, F.array(F.struct(bar["seq"].alias("seq"), held.alias("held"))))

    return F.aggregate(bars, empty, step)


def capped_names(
    scores: DataFrame, caps: DataFrame, chunk_rows: int = 256
) -> DataFrame:
    """Holdings when at most ``max_positions`` names may be held.

    What is held depends on what was held before, so bars are walked in order. To
    spread the walk over tasks, it is cut into chunks that all start at once from a
    guess (nothing held), then again from what the chunk before ended with, until no
    start changes any more. The result is that of one sequential walk: once the
    starts agree with the ends, every chunk continues the one before it. ``caps``
    holds ``lookback, entry_z, exit_z, max_positions``.
    """
    keys = [*_LEVELS, "max_positions"]
    order = lambda rows: F.transform(F.array_sort(rows), lambda e: e["symbol"])
    live = F.struct("z", "symbol")
    per_bar = (
        scores.join(caps, _LEVELS)
        .groupBy(*keys, "seq")
        .agg(
            F.collect_list(F.when(F.col("z") < F.col("exit_z"), F.col("symbol"))).alias("keep"),
            order(F.collect_list(F.when(F.col("z") < -F.col("entry_z"), live))).alias("enter"),
        )
    )
    lone_step = F.struct("seq", F.col("max_positions").alias("room"), "keep", "enter")
    chunks = per_bar.groupBy(*keys, F.floor(F.col("seq") / chunk_rows).alias("chunk")).agg(
        F.array_sort(F.collect_list(lone_step)).alias("bars")
    )
    none = F.array().cast("array<string>")
    walked = durable(
        chunks.withColumns({"start": none, "walk": _fold_bars(F.col("bars"), none)})
    )
    in_order = Window.partitionBy(*keys).orderBy("chunk")
    while True:
        starts = walked.select(
            *keys,
            "chunk",
            F.coalesce(
                F.lag(F.element_at("walk", -1)["held"]).over(in_order), none
            ).alias("new_start"),
        )
        linked = walked.join(starts, [*keys, "chunk"])
        moved = F.array_sort("new_start") != F.array_sort("start")
        if linked.filter(moved).isEmpty():
            break
        walked = durable(
            linked.select(
                *keys,
                "chunk",
                "bars",
                F.col("new_start").alias("start"),
                F.when(moved, _fold_bars(F.col("bars"), F.col("new_start")))
                .otherwise(F.col("walk"))
                .alias("walk"),
            )
        )
    return (
        walked.select(*keys, F.explode("walk").alias("w"))
        .select(*keys, F.col("w.seq").alias("seq"), F.explode("w.held").alias("symbol"))
    )


@register("mean_reversion")
def mean_reversion(panel: DataFrame, runs: Sequence[Run], length: Column | int) -> Signal:
    """Buy the most oversold symbols and keep each until it has recovered.

    Where the cap on positions never binds, holdings follow from window functions
    alone; only the settings for which it binds are walked bar by bar.
    """
    spark = panel.sparkSession
    params = _params_frame(
        spark,
        runs,
        lookback=("int", 20),
        entry_z=("double", 1.0),
        exit_z=("double", 0.0),
        max_positions=("int", 5),
        gross=("double", 1.0),
    )
    keys = [*_LEVELS, "max_positions"]
    scores = durable(scored(panel, sorted({_levels(r) for r in runs}), length))
    free = durable(held_names(scores, chunk_for(length)))
    most = (
        free.groupBy(*_LEVELS, "seq")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*_LEVELS)
        .agg(F.max("n").alias("most"))
    )
    binds = F.coalesce(F.col("most") > F.col("max_positions"), F.lit(False))
    caps = durable(
        params.select(*keys).distinct().join(most, _LEVELS, "left").withColumn("binds", binds)
    )
    names = free.join(caps.filter(~F.col("binds")).select(*keys), _LEVELS).select(
        *keys, "seq", "symbol"
    )
    binding = caps.filter("binds").select(*keys)
    if not binding.isEmpty():
        names = names.unionByName(capped_names(scores, binding).select(*keys, "seq", "symbol"))
    shared = equal_weight(names, [*keys, "seq"], F.lit(1.0))
    weights = shared.join(params, keys).select(
        "run_id", "seq", "symbol", (F.col("weight") * F.col("gross")).alias("weight")
    )
    warmups = {r.run_id: int(r.params.get("lookback", 20)) for r in runs}
    return Signal(weights, _every_bar(params, "lookback", length), warmups)


@register("momentum")
def momentum(panel: DataFrame, runs: Sequence[Run], length: Column | int) -> Signal:
    """Everything into the best trailing performer, reviewed every 21st bar."""
    params = _params_frame(panel.sparkSession, runs, lookback=("int", 60))
    review = 21  # fixed value: bars between reviews
    lookbacks = sorted({int(r.params.get("lookback", 60)) for r in runs})

    def gains(w):
        return {
            f"gain_{n}": F.try_divide(
                F.col("close"), F.max("close").over(w.rangeBetween(-(n - 1), -(n - 1)))
            )
            - 1
            for n in lookbacks
        }

    rows = scans.rolling(
        panel.select("symbol", "seq", "close"),
        ["symbol"],
        "seq",
        max(lookbacks),
        gains,
        chunk_for(length),
    ).filter((F.col("seq") % review == 0) & (F.col("seq") < length - 1))
    item = lambda n: F.struct(F.lit(n).alias("lookback"), F.col(f"gain_{n}").alias("gain"))
    best = (
        rows.select("symbol", "seq", F.explode(F.array(*[item(n) for n in lookbacks])).alias("g"))
        .select("symbol", "seq", "g.*")
        .filter(F.col("gain").isNotNull() & (F.col("seq") >= F.col("lookback")))
        .groupBy("lookback", "seq")
        .agg(F.min_by("symbol", F.struct((-F.col("gain")).alias("g"), "symbol")).alias("symbol"))
    )
    weights = best.join(params, "lookback").select(
        "run_id", "seq", "symbol", F.lit(1.0).alias("weight")
    )
    decisions = _every_bar(params, "lookback", length).withColumn(
        "is_hold", F.col("seq") % review != 0
    )
    return Signal(weights, decisions, {r.run_id: int(r.params.get("lookback", 60)) for r in runs})


def python_signal(
    panel: DataFrame,
    score: Callable[[pd.DataFrame], pd.Series],
    lookback: int,
    name: str = "close",
    out: str = "score",
) -> DataFrame:
    """Score each symbol and bar with a Python function of its recent history.

    ``score`` receives a batch of histories as a frame with one column per lag
    (``lag_0`` is the current bar) and returns one number per row. It sees no later
    bar, whatever it does. Bars without a full history get NULL.
    """
    past = indicators.history(panel, lookback, name)
    full = F.size("history") == lookback
    # The history array is ordered by time, so the current bar is its last entry.
    values = F.when(full, F.transform("history", lambda h: h["value"]))

    @F.pandas_udf(T.DoubleType())
    def run(batches: pd.Series) -> pd.Series:
        ready = batches[batches.notna()]
        result = pd.Series([None] * len(batches), index=batches.index, dtype="float64")
        if len(ready):
            wide = pd.DataFrame(ready.tolist(), index=ready.index, dtype="float64")
            wide.columns = [f"lag_{lookback - 1 - i}" for i in range(lookback)]
            result[ready.index] = score(wide).astype("float64")
        return result

    return past.withColumn(out, run(values)).drop("history")
