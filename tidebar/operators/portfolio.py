"""Portfolio accounting for many runs without a simulation loop.

Targets decided at the close of a bar trade at the open of the next one. Between
two rebalances holdings do not change, so equity compounds from one rebalance to
the next by a factor that only needs the two rebalances and the cost of the first:

    G = cash left after trading, with interest + sum(w * open / previous open)

Trading cost depends on G and G on the cost before it. Passes over the rebalances
settle both: each makes one more rebalance exact and shrinks the error of the others by about the
cost rate. They go on until no cost moves by more than ``SETTLED``.

Cash is positive or a debt, at different rates. Between two rebalances it only shrinks by
charges on short positions, so it turns once at most, at the bar where the charges
discounted to the rebalance reach it. Up to there and from there on it compounds in
closed form.

A rebalance at which no equity is left is skipped and the book is held, until a later one
finds equity again. A symbol without a price above zero is not traded; its shares are
held through that rebalance, and count again at the first one that can trade them.

Orders here may be of any size. Whole shares, minimum commissions and minimum order
sizes depend on the account's absolute size at each step; they are honoured by
:func:`lump_sum_buy` and, for given fills, by :func:`ledger_from_fills`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions import trading
from tidebar.functions.timeframe import TimeFrame
from tidebar.functions.trading import finite
from tidebar.operators import bars as bar_ops
from tidebar.operators import metrics, scans, signals
from tidebar.operators.signals import Run, Signal
from tidebar.session import durable

PASSES = 5  # between two looks at how far costs still move
SETTLED = 1e-14  # share of equity
ROUNDS = 200
_ORDER_CHUNK = 4096
_DUST = 1e-12  # share of equity below which a difference is rounding noise


def _chunk(column: str, chunk_rows: int | None) -> Column | None:
    return None if chunk_rows is None else F.floor(F.col(column) / chunk_rows)


def normalise_weights(weights: DataFrame, accounts: DataFrame) -> DataFrame:
    """Drop missing targets and scale down to the leverage cap of the run."""
    caps = accounts.select("run_id", "max_leverage")
    clean = weights.select(
        "run_id", "seq", "symbol", F.coalesce(finite(F.col("weight")), F.lit(0.0)).alias("weight")
    ).join(caps, "run_id")
    gross = F.sum(F.abs("weight")).over(Window.partitionBy("run_id", "seq"))
    cap = F.col("max_leverage")
    scale = F.when((cap > 0) & (gross > cap), cap / gross).otherwise(1.0)
    return (
        clean.withColumn("weight", F.col("weight") * scale)
        .filter(F.col("weight") != 0)
        .drop("max_leverage")
    )


def missing_decisions(decisions: DataFrame, length: int, warmups: DataFrame) -> DataFrame:
    """Runs that decided on fewer bars than they had to: ``run_id, expected, found``."""
    found = decisions.groupBy("run_id").agg(F.count_distinct("seq").alias("found"))
    expected = F.greatest(F.lit(length) - 1 - F.col("warmup"), F.lit(0))
    return (
        warmups.select("run_id", expected.cast("long").alias("expected"))
        .join(found, "run_id", "left")
        .withColumn("found", F.coalesce("found", F.lit(0)))
        .filter(F.col("found") < F.col("expected"))
    )


def schedule_rebalances(
    decisions: DataFrame, length: Column, chunk_rows: int | None = None
) -> DataFrame:
    """Rebalances ``run_id, e, s, s_next``: number, bar of trading, bar of the next one."""
    traded = decisions.filter(~F.col("is_hold")).select(
        "run_id", (F.col("seq") + 1).alias("s")
    )
    return _scheduled(traded, length, chunk_rows)


def _scheduled(traded: DataFrame, length: Column, chunk_rows: int | None) -> DataFrame:
    counted = scans.running(
        traded, ["run_id"], ["s"], _chunk("s", chunk_rows), e=scans.row_count()
    )
    backwards = counted.withColumn("__back", -F.col("s"))
    back_chunk = None if chunk_rows is None else -F.floor(F.col("s") / chunk_rows)
    following = scans.previous(
        backwards, ["run_id"], ["__back"], back_chunk, F.col("s"), "s_next"
    )
    return following.select(
        "run_id", (F.col("e") - 1).alias("e"), "s", F.coalesce("s_next", length).alias("s_next")
    )


def legs_of(
    weights: DataFrame, rebalances: DataFrame, grid: DataFrame, length: Column
) -> DataFrame:
    """Holdings opened by each rebalance ``e`` at price ``o``, and where they end.

    They end at the next rebalance ``e_next`` (bar ``s_next``, price ``o_next``) at which the
    symbol can be traded, or behind the last bar without a price.
    """
    prices = grid.select("symbol", "seq", "trade_price", "tradable")
    opened = prices.filter("tradable").select(
        "symbol", F.col("seq").alias("s"), F.col("trade_price").alias("o")
    )
    closed = prices.select(
        "symbol", F.col("seq").alias("s_next"), F.col("trade_price").alias("o_next"),
        F.col("tradable").alias("ends"),
    )
    legs = (
        weights.select("run_id", "symbol", (F.col("seq") + 1).alias("s"), F.col("weight").alias("w"))
        .join(rebalances, ["run_id", "s"])
        .join(opened, ["symbol", "s"])
        .join(closed, ["symbol", "s_next"], "left")
        .withColumn("e_next", F.col("e") + 1)
    )
    columns = ["run_id", "symbol", "e", "s", "w", "o", "e_next", "s_next", "o_next"]
    if grid.filter("trade_price <= 0").isEmpty():
        return legs.select(columns)
    stuck = legs.filter("NOT ends").withColumn("from", F.col("e_next")).drop("e_next", "s_next", "o_next")
    later = rebalances.select("run_id", F.col("e").alias("e_next"), F.col("s").alias("s_next"))
    ends = closed.filter("ends").drop("ends")
    found = (
        stuck.select("run_id", "symbol", "e", "from")
        .join(later, "run_id")
        .filter(F.col("e_next") > F.col("from"))
        .join(ends, ["symbol", "s_next"])
        .groupBy("run_id", "symbol", "e")
        .agg(F.min(F.struct("e_next", "s_next", "o_next")).alias("end"))
    )
    late = stuck.join(found, ["run_id", "symbol", "e"], "left").select(
        "run_id", "symbol", "e", "s", "w", "o", F.col("end.e_next").alias("e_next"),
        F.coalesce("end.s_next", length).alias("s_next"), F.col("end.o_next").alias("o_next"),
    )
    return legs.filter("ends IS NULL OR ends").select(columns).unionByName(late)


def _bars_of(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("s_next") > F.col("s")).select(
        "*", F.explode(F.sequence(F.col("s"), F.col("s_next") - 1)).alias("seq")
    )


def _rates(accounts: DataFrame, dt: float) -> DataFrame:
    return accounts.withColumns(
        {
            "grow_cash": 1 + F.col("cash_rate") * dt,
            "grow_debt": 1 + F.col("borrow_rate") * dt,
            "short_rate": F.col("borrow_rate") * dt,
        }
    )


def _short_charges(legs: DataFrame, grid: DataFrame, rates: DataFrame) -> DataFrame:
    """Borrowing charge per run and bar, as a share of equity at the rebalance."""
    lent = legs.filter(F.col("w") < 0).join(
        rates.filter(F.col("short_rate") != 0).select("run_id", "short_rate"), "run_id"
    )
    marks = grid.select("symbol", "seq", F.coalesce("prev_mark", F.lit(0.0)).alias("before"))
    charge = -F.col("w") * F.col("before") / F.col("o") * F.col("short_rate")
    return (
        _bars_of(lent)
        .join(marks, ["symbol", "seq"])
        .groupBy("run_id", "e", "seq")
        .agg(F.sum(charge).alias("h"))
    )


def rebalance_growth(
    legs: DataFrame,
    rebalances: DataFrame,
    grid: DataFrame,
    accounts: DataFrame,
    timeframe: str | TimeFrame = "1Day",
    chunk_rows: int | None = None,
    passes: int = PASSES,
) -> DataFrame:
    """Equity and trades of every rebalance, as a written table.

    Result: the rebalance, ``equity`` at its open before costs, ``cost`` and ``net``
    (sum of weights) as shares of it, and ``trades`` with the change of weight ``x``
    and price ``o`` per symbol. ``turns`` says that cash becomes a debt before the next
    rebalance. From the first rebalance without equity on, rows are ``ruined`` and mean
    nothing; ``Sweep`` skips such rebalances.
    """
    rates = _rates(accounts, 1 / TimeFrame.of(timeframe).periods_per_year)
    rows = _rebalance_rows(legs, rebalances, grid, rates, ["run_id"] if chunk_rows is None else ["run_id", "e"])
    late = legs.filter(F.col("e_next") > F.col("e") + 1)
    late = None if late.isEmpty() else durable(
        late.filter("o_next IS NOT NULL").select("run_id", F.col("e_next").alias("e"), F.col("e").alias("base")).distinct()
    )
    known = None
    for _ in range(ROUNDS):
        growth = durable(_passes(rows, known, late, chunk_rows, passes))
        moved = growth.agg(F.max(F.when(~F.col("ruined"), F.col("moved")))).first()[0]
        if (moved or 0.0) <= SETTLED:
            return growth.drop("moved", "growth")
        known = growth.select("run_id", "e", F.col("cost").alias("k"), "growth")
    raise ArithmeticError(f"costs still move by {moved} of equity after {ROUNDS * passes} passes")


def _rebalance_rows(
    legs: DataFrame, rebalances: DataFrame, grid: DataFrame, rates: DataFrame, dealt: Sequence[str]
) -> DataFrame:
    """One row per rebalance with its possible moves and the charges until the next one.

    One shuffle on the columns ``dealt`` serves both groupings and the passes that follow.

    ``wr`` is what is left of a holding at the rebalance, as a share of equity at the
    rebalance before; of one that could not be traded then, at the rebalance ``base``.
    """
    after = F.col("w") * F.col("o_next") / F.col("o")
    base = F.when(F.col("e_next") > F.col("e") + 1, F.col("e"))
    none, zero = F.lit(None).cast("long"), F.lit(0.0)
    bars_ = [none.alias("s"), none.alias("s_next")]
    old = legs.filter(F.col("o_next").isNotNull()).select(
        "run_id",
        F.col("e_next").alias("e"),
        "symbol",
        zero.alias("w"),
        after.alias("wr"),
        F.col("o_next").alias("o"),
        base.alias("base"),
        *bars_,
    )
    new = legs.select(
        "run_id", "e", "symbol", "w", zero.alias("wr"), "o", none.alias("base"), *bars_
    )
    # Rebalances into nothing have no holdings, so each adds a row without a symbol.
    every = rebalances.select(
        "run_id", "e", F.lit(None).cast("string").alias("symbol"), zero.alias("w"), zero.alias("wr"),
        F.lit(None).cast("double").alias("o"), none.alias("base"), "s", "s_next",
    )
    slip = F.col("slippage_bps") / 10_000.0
    fee = F.col("commission_bps") / 10_000.0
    fixed = slip + F.col("commission_per_share") / F.col("o")
    buying, selling = fixed + (1 + slip) * fee, fixed + (1 - slip) * fee
    priced = {
        "buy_w": F.col("w") * buying,
        "buy_wr": F.col("wr") * buying,
        "sell_w": F.col("w") * selling,
        "sell_wr": F.col("wr") * selling,
    }
    costs = rates.select("run_id", "slippage_bps", "commission_per_share", "commission_bps")
    move = F.when(F.col("symbol").isNotNull(), F.struct("symbol", "w", "wr", "o", "base", *priced))
    moves = (
        new.unionByName(old)
        .unionByName(every)
        .repartition(*dealt)
        .groupBy("run_id", "e", "symbol")
        .agg(
            F.sum("w").alias("w"), F.sum("wr").alias("wr"), F.max("o").alias("o"),
            F.max("base").alias("base"), F.max("s").alias("s"), F.max("s_next").alias("s_next"),
        )
        .join(costs, "run_id")
        .withColumns(priced)
        .groupBy("run_id", "e")
        .agg(
            F.collect_list(move).alias("moves"),
            F.max("s").alias("s"),
            F.max("s_next").alias("s_next"),
            F.sum("w").alias("net"),
            F.sum(F.when(F.col("base").isNull(), F.col("wr"))).alias("grown"),
        )
    )
    if rates.filter("short_rate <> 0").isEmpty():
        charged = moves.withColumns({"charge_cash": zero, "charges": F.lit(None).cast("array<double>")})
    else:
        charged = moves.join(_charged(legs, rebalances, grid, rates), ["run_id", "e"], "left")
    return charged.join(
        rates.select("run_id", "initial_cash", "grow_cash", "grow_debt"), "run_id"
    ).withColumns({c: F.coalesce(c, zero) for c in ("charge_cash", "net", "grown")})


def _charged(
    legs: DataFrame, rebalances: DataFrame, grid: DataFrame, rates: DataFrame
) -> DataFrame:
    """Charges per rebalance: bar by bar, and what they sum up to while cash is positive."""
    charges = (
        _short_charges(legs, grid, rates)
        .join(rebalances, ["run_id", "e"])
        .join(rates.select("run_id", "grow_cash"), "run_id")
    )
    left = F.col("s_next") - 1 - F.col("seq")
    return charges.groupBy("run_id", "e").agg(
        F.sum(F.col("h") * F.pow("grow_cash", left)).alias("charge_cash"),
        F.sort_array(F.collect_list(F.struct("seq", "h"))).getField("h").alias("charges"),
    )


def _passes(
    rows: DataFrame, known: DataFrame | None, late: DataFrame | None, chunk_rows: int | None, passes: int
) -> DataFrame:
    """Costs after some more passes, starting from those ``known``, and what follows from them."""
    zero = F.lit(0.0)
    if known is None:
        rows = rows.withColumns({"k": zero, "past": F.lit(None).cast("double")})
    else:
        rows = rows.join(known.select("run_id", "e", "k", F.col("growth").alias("past")), ["run_id", "e"])
    if late is not None:
        # Equity at the rebalance a late holding comes from, relative to that before it ends.
        ratio = F.lit(1.0)
        pairs = late
        if known is not None:
            at = known.select("run_id", F.col("e").alias("base"), F.col("growth").alias("then"))
            last = known.select("run_id", (F.col("e") + 1).alias("e"), F.col("growth").alias("now"))
            pairs = late.join(at, ["run_id", "base"]).join(last, ["run_id", "e"])
            ratio = F.try_divide(F.col("then"), F.col("now"))
        ratios = pairs.groupBy("run_id", "e").agg(
            F.map_from_entries(F.collect_list(F.struct("base", ratio.alias("ratio")))).alias("ratios")
        )
        rows = rows.join(ratios, ["run_id", "e"], "left")

    def since(m: Column, inverse: Column) -> Column:
        """What a holding's share is divided by, as an inverse."""
        if late is None:
            return inverse
        return F.when(m["base"].isNull(), inverse).otherwise(
            inverse * F.try_element_at("ratios", m["base"])
        )

    def cost(inverse: Column) -> Column:
        """Cost of moving from the old weights, divided by G, to the new ones.

        A purchase is dearer than a negative sale and the other way round, so the
        greater of both is the cost of a trade in either direction.
        """

        def one(m: Column) -> Column:
            inv = since(m, inverse)
            return F.greatest(m["buy_w"] - m["buy_wr"] * inv, m["sell_wr"] * inv - m["sell_w"])

        return F.coalesce(F.aggregate("moves", zero, lambda t, m: t + one(m)), zero)

    cash = 1 - F.col("k") - F.col("net")
    kept = cash * F.pow("grow_cash", F.col("s_next") - F.col("s")) - F.col("charge_cash")
    step = lambda c, h: c * F.when(c > 0, F.col("grow_cash")).otherwise(F.col("grow_debt")) - h
    # Cash that stays positive, a debt without charges, and what the bars make of the others.
    end = (
        F.when((cash > 0) & (kept > 0), kept)
        .when(
            F.col("charges").isNull(),
            F.when(cash > 0, kept).otherwise(cash * F.pow("grow_debt", F.col("s_next") - F.col("s"))),
        )
        .otherwise(F.aggregate("charges", cash, step))
    )
    grown = F.col("grown")
    if late is not None:
        again = F.filter("moves", lambda m: m["base"].isNotNull())
        grown = grown + F.coalesce(
            F.aggregate(again, zero, lambda t, m: t + m["wr"] * F.try_element_at("ratios", m["base"])), zero
        )
    if chunk_rows is None:
        spread, keys = rows, ["run_id"]
    else:
        reach = F.floor((F.col("e") + passes + 1) / chunk_rows)
        own = F.floor(F.col("e") / chunk_rows)
        spread = rows.select("*", F.explode(F.sequence(own, reach)).alias(scans.CHUNK))
        keys = ["run_id", scans.CHUNK]
    w = Window.partitionBy(*keys).orderBy("e")
    first = F.pow("grow_cash", F.col("s"))
    solved = spread.withColumn("before", F.col("k"))
    for _ in range(passes):
        factor = F.when(F.col("e") == 0, first).otherwise(
            F.coalesce(F.lag("end").over(w) + grown, F.lit(1.0))
        )
        solved = (
            solved.withColumns({"end": end, "before": F.col("k")})
            .withColumn("g", factor)
            .withColumn("inverse", F.try_divide(F.lit(1.0), F.col("g")))
            .withColumn("k", cost(F.col("inverse")))
        )
    if chunk_rows is not None:
        solved = solved.filter(F.col(scans.CHUNK) == F.floor(F.col("e") / chunk_rows))
    change = lambda m: m["w"] - m["wr"] * since(m, F.col("inverse"))
    trades = F.transform(
        F.filter("moves", lambda m: F.abs(change(m)) > _DUST),
        lambda m: F.struct(m["symbol"].alias("symbol"), change(m).alias("x"), m["o"].alias("o")),
    )
    moved = F.abs(F.col("k") - F.col("before"))
    out = scans.running(
        solved.select(
            "run_id", "e", "s", "s_next", "net", F.col("k").alias("cost"), "g", moved.alias("moved"),
            ((cash > 0) & (kept <= 0) & F.col("charges").isNotNull()).alias("turns"),
            trades.alias("trades"), "initial_cash", "past",
        ),
        ["run_id"],
        ["e"],
        _chunk("e", chunk_rows),
        growth=scans.running_product(F.col("g")),
        worst=scans.running_min(F.col("g")),
    )
    moved = F.col("moved")
    if late is not None:  # their ratios are those of the round before, at first a guess
        shift = F.abs(F.try_divide(F.col("growth"), F.col("past")) - 1)
        moved = F.greatest(moved, F.coalesce(shift, F.lit(1.0)))
    return out.select(
        "run_id",
        "e",
        "s",
        "s_next",
        "net",
        "cost",
        (F.col("initial_cash") * F.col("growth")).alias("equity"),
        F.coalesce(F.col("worst") <= 0, F.lit(True)).alias("ruined"),
        "turns",
        "trades",
        moved.alias("moved"),
        "growth",
    )


def fills_from_weights(growth: DataFrame, accounts: DataFrame, line: DataFrame) -> DataFrame:
    """Every trade of every run as a fill."""
    costs = accounts.select(
        "run_id", "slippage_bps", "commission_per_share", "commission_bps"
    )
    trades = (
        growth.select("run_id", F.col("s").alias("seq"), "equity", F.explode("trades").alias("t"))
        .select(
            "run_id",
            "seq",
            F.col("t.symbol").alias("symbol"),
            (F.col("t.x") * F.col("equity") / F.col("t.o")).alias("shares"),
            F.col("t.o").alias("reference_price"),
        )
        .join(costs, "run_id")
        .join(line, "seq")
    )
    return priced_fills(trades.withColumn("min_commission", F.lit(0.0)))


def priced_fills(trades: DataFrame) -> DataFrame:
    """Fill table from signed shares, reference prices and cost settings."""
    shares, price = F.col("shares"), F.col("price")
    return trades.withColumn(
        "price", trading.fill_price(F.col("reference_price"), shares, F.col("slippage_bps"))
    ).select(
        "run_id",
        "ts",
        "seq",
        "symbol",
        trading.side(shares).alias("side"),
        "shares",
        "price",
        "reference_price",
        trading.notional(shares, price).alias("notional"),
        trading.commission(
            shares,
            price,
            F.col("commission_per_share"),
            F.col("commission_bps"),
            F.col("min_commission"),
        ).alias("commission"),
        trading.slippage_cost(shares, price, F.col("reference_price")).alias("slippage_cost"),
    )


def mark_to_market(
    legs: DataFrame,
    growth: DataFrame,
    grid: DataFrame,
    accounts: DataFrame,
    line: DataFrame,
    length: Column,
    timeframe: str | TimeFrame = "1Day",
    chunk_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Equity per run and bar, and holdings per run, bar and symbol, at the close."""
    rates = _rates(accounts, 1 / TimeFrame.of(timeframe).periods_per_year)
    started = growth.groupBy("run_id").agg(F.min("s").alias("s_next"))
    waiting = (
        rates.join(started, "run_id", "left")
        .select(
            "run_id",
            F.lit(-1).cast("long").alias("e"),
            F.lit(0).cast("long").alias("s"),
            F.coalesce("s_next", length).alias("s_next"),
            F.lit(0.0).alias("net"),
            F.lit(0.0).alias("cost"),
            F.col("initial_cash").alias("equity"),
            F.lit(False).alias("turns"),
        )
    )
    epochs = growth.select(*waiting.columns).unionByName(waiting)
    marks = grid.select("symbol", "seq", "mark")
    # Late holdings outlast their rebalance, so shares are counted from its equity.
    owned = legs.select("run_id", "e", "symbol", "w", "o", "s", "s_next").join(
        growth.select("run_id", "e", "equity"), ["run_id", "e"]
    )
    held = (
        _bars_of(owned.withColumn("shares", F.col("w") * F.col("equity") / F.col("o")))
        .join(marks, ["symbol", "seq"])
        .withColumn("part", F.col("shares") * F.coalesce("mark", F.lit(0.0)))
        .select("run_id", "seq", "symbol", "shares", "part")
    )
    parts = held.groupBy("run_id", "seq").agg(F.sum("part").alias("part"))
    charges = _short_charges(legs, grid, rates).select("run_id", "seq", "h")
    per_bar = (
        _bars_of(epochs)
        .join(parts, ["run_id", "seq"], "left")
        .join(charges, ["run_id", "seq"], "left")
        .join(rates.select("run_id", "grow_cash", "grow_debt"), "run_id")
        .withColumns(
            {
                "cash0": 1 - F.col("cost") - F.col("net"),
                "j": F.col("seq") - F.col("s") + 1,
                "h": F.coalesce("h", F.lit(0.0)),
            }
        )
    )
    chunk = _chunk("seq", chunk_rows)
    f = F.when(F.col("cash0") > 0, F.col("grow_cash")).otherwise(F.col("grow_debt"))
    owed = scans.running_sum(F.col("h") * F.pow(f, -F.col("j")))
    plain = scans.running(per_bar.filter("NOT turns"), ["run_id", "e"], ["seq"], chunk, owed=owed)
    shared = plain.withColumn("share", F.pow(f, "j") * (F.col("cash0") - F.col("owed")))
    if not growth.filter("turns").isEmpty():
        shared = shared.unionByName(
            _turning(per_bar.filter("turns"), chunk).select(*shared.columns)
        )
    total = F.col("equity") * F.col("share") + F.coalesce("part", F.lit(0.0))
    equity = shared.join(line, "seq").select(
        "run_id",
        "seq",
        "ts",
        total.alias("equity"),
        (F.col("equity") * F.col("share")).alias("cash"),
    )
    value = equity.select("run_id", "seq", "ts", F.col("equity").alias("total"))
    holdings = held.join(value, ["run_id", "seq"]).select(
        "run_id",
        "seq",
        "ts",
        "symbol",
        "shares",
        F.coalesce(F.try_divide(F.col("part"), F.col("total")), F.lit(0.0)).alias("weight"),
    )
    return equity, holdings


def _turning(rows: DataFrame, chunk: Column | None) -> DataFrame:
    """Cash as a ``share`` of equity on the bars of rebalances after which it becomes a debt.

    Charges discounted to the rebalance never shrink, so cash turns at the first bar
    where they reach it, which a running minimum finds; charges after it are discounted at the
    rate of a debt.
    """
    keys, j = ["run_id", "e"], F.col("j")
    summed = scans.running(
        rows,
        keys,
        ["seq"],
        chunk,
        owed=scans.running_sum(F.col("h") * F.pow("grow_cash", -j)),
        due=scans.running_sum(F.col("h") * F.pow("grow_debt", -j)),
    )
    turned = F.col("owed") >= F.col("cash0")
    placed = scans.running(
        summed,
        keys,
        ["seq"],
        chunk,
        turn_j=scans.running_min(F.when(turned, j)),
        turn_owed=scans.running_min(F.when(turned, F.col("owed"))),
        turn_due=scans.running_min(F.when(turned, F.col("due"))),
    )
    before = F.pow("grow_cash", j) * (F.col("cash0") - F.col("owed"))
    debt = F.pow("grow_cash", "turn_j") * (F.col("cash0") - F.col("turn_owed"))
    after = debt * F.pow("grow_debt", j - F.col("turn_j")) - F.pow("grow_debt", j) * (
        F.col("due") - F.col("turn_due")
    )
    share = F.when(F.col("turn_j").isNull(), before).otherwise(after)
    return placed.withColumn("share", share)


def equity_table(
    equity: DataFrame,
    holdings: DataFrame,
    fills: DataFrame,
    chunk_seconds: int | None = None,
) -> DataFrame:
    """Equity, cash, return, drawdown, exposures and turnover per run and bar."""
    zero = F.lit(0.0)
    out = metrics.equity_returns(
        equity.select("run_id", "ts", "equity", "cash"), chunk_seconds=chunk_seconds
    )
    out = metrics.drawdown(out, "equity", chunk_seconds=chunk_seconds)
    out = metrics.turnover(fills, out).join(
        metrics.exposure(holdings), ["run_id", "ts"], "left"
    )
    return out.select(
        "run_id",
        "ts",
        "equity",
        "cash",
        F.col("r").alias("returns"),
        "drawdown",
        F.coalesce("gross_exposure", zero).alias("gross_exposure"),
        F.coalesce("net_exposure", zero).alias("net_exposure"),
        "turnover",
    )


def lump_sum_buy(
    weights: DataFrame,
    grid: DataFrame,
    accounts: DataFrame,
    line: DataFrame,
    whole_shares: bool = False,
    min_trade_notional: float = 1.0,
) -> DataFrame:
    """Fills that invest the initial cash once, at the bar after the first targets.

    Whole shares are rounded toward zero, the minimum commission applies, and orders
    below ``min_trade_notional`` are left out.
    """
    first = weights.groupBy("run_id").agg(F.min("seq").alias("seq"))
    orders = (
        normalise_weights(weights.join(first, ["run_id", "seq"], "left_semi"), accounts)
        .select("run_id", "symbol", (F.col("seq") + 1).alias("seq"), "weight")
        .join(grid.filter("tradable").select("symbol", "seq", "trade_price"), ["symbol", "seq"])
        .join(accounts.drop("max_leverage"), "run_id")
        .join(line, "seq")
    )
    shares = F.col("weight") * F.col("initial_cash") / F.col("trade_price")
    sized = orders.select(
        "*",
        (trading.whole_shares(shares) if whole_shares else shares).alias("shares"),
        F.col("trade_price").alias("reference_price"),
    ).filter(
        (F.col("shares") != 0)
        & (F.abs(F.col("shares") * F.col("reference_price")) >= min_trade_notional)
    )
    return priced_fills(sized)


def running_position(fills: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Shares held after each bar on which a symbol traded."""
    per_bar = fills.groupBy("run_id", "symbol", "seq").agg(F.sum("shares").alias("traded"))
    return scans.running(
        per_bar,
        ["run_id", "symbol"],
        ["seq"],
        _chunk("seq", chunk_rows),
        position=scans.running_sum(F.col("traded")),
    )


def _amount(value: Column, digits: int | None) -> Column:
    """``value`` as a decimal of so many digits, whose sums do not depend on their order."""
    return value if digits is None else F.round(value, digits).cast(f"decimal(28,{digits})")


def running_cash(
    fills: DataFrame,
    accounts: DataFrame,
    chunk_rows: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Cash after each bar on which a run traded, without financing."""
    spent = _amount(F.col("shares") * F.col("price") + F.col("commission"), digits)
    per_bar = fills.groupBy("run_id", "seq").agg(F.sum(-spent).alias("flow"))
    return (
        scans.running(
            per_bar,
            ["run_id"],
            ["seq"],
            _chunk("seq", chunk_rows),
            paid=scans.running_sum(F.col("flow")),
        )
        .join(accounts.select("run_id", "initial_cash"), "run_id")
        .select(
            "run_id",
            "seq",
            F.col("flow").cast("double").alias("flow"),
            (F.col("initial_cash") + F.col("paid").cast("double")).alias("cash"),
        )
    )


def _positions_per_bar(
    fills: DataFrame, length: Column, chunk_rows: int | None
) -> DataFrame:
    """Position after every bar, from the first fill of a symbol on."""
    per_bar = fills.groupBy("run_id", "symbol", "seq").agg(
        F.sum("shares").alias("traded"), F.sum(F.abs("shares")).alias("volume")
    )
    held = scans.running(
        per_bar,
        ["run_id", "symbol"],
        ["seq"],
        _chunk("seq", chunk_rows),
        position=scans.running_sum(F.col("traded")),
        total=scans.running_sum(F.col("volume")),
    ).withColumn("__back", -F.col("seq"))
    back_chunk = None if chunk_rows is None else -F.floor(F.col("seq") / chunk_rows)
    spans = scans.previous(
        held, ["run_id", "symbol"], ["__back"], back_chunk, F.col("seq"), "s_next"
    ).select(
        "run_id",
        "symbol",
        "position",
        "total",
        F.col("seq").alias("s"),
        F.coalesce("s_next", length).alias("s_next"),
    )
    # A position that was closed is flat; what is left of all that was traded is rounding noise.
    return _bars_of(spans.filter(F.abs("position") > _DUST * F.col("total")).drop("total"))


def ledger_from_fills(
    fills: DataFrame,
    grid: DataFrame,
    accounts: DataFrame,
    line: DataFrame,
    length: Column,
    timeframe: str | TimeFrame = "1Day",
    chunk_rows: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Cash and equity per run and bar for any table of fills, priced at the close.

    With financing, cash grows at the lending or the borrowing rate depending on its
    sign. Given the signs of all bars, cash is a running sum. Signs are first taken from
    the cash without interest and then from the result, until none moves any more: cash on a bar depends on
    earlier signs only, so each pass settles one more bar at least and what is settled is the
    account itself. With ``digits``, amounts are rounded to them and added up exactly.
    """
    zero = F.lit(0.0)
    rates = _rates(accounts, 1 / TimeFrame.of(timeframe).periods_per_year)
    financed = not accounts.filter("cash_rate <> 0 OR borrow_rate <> 0").isEmpty()
    marks = grid.select(
        "symbol",
        "seq",
        F.coalesce("mark", zero).alias("mark"),
        F.coalesce("prev_mark", zero).alias("before"),
    )
    worth = (
        _positions_per_bar(fills, length, chunk_rows)
        .join(marks, ["symbol", "seq"])
        .groupBy("run_id", "seq")
        .agg(
            F.sum(_amount(F.col("position") * F.col("mark"), digits)).cast("double").alias("held"),
            F.sum(F.when(F.col("position") < 0, -F.col("position") * F.col("before"))).alias(
                "short"
            ),
        )
    )
    flows = fills.groupBy("run_id", "seq").agg(
        F.sum(-_amount(F.col("shares") * F.col("price") + F.col("commission"), digits)).alias("flow")
    )
    every = rates.select("*", F.explode(F.sequence(F.lit(0).cast("long"), length - 1)).alias("seq"))
    rows = (
        every.join(worth, ["run_id", "seq"], "left")
        .join(flows, ["run_id", "seq"], "left")
        .withColumns(
            {
                "held": F.coalesce("held", zero),
                "flow": F.coalesce("flow", _amount(zero, digits)),
                "charge": F.coalesce("short", zero) * F.col("short_rate"),
            }
        )
    )
    chunk = _chunk("seq", chunk_rows)
    plain = scans.running(
        rows, ["run_id"], ["seq"], chunk, paid=scans.running_sum(F.col("flow"))
    ).withColumn("traded", F.col("initial_cash") + F.col("paid").cast("double"))
    out = plain.withColumn("cash", F.col("traded"))
    moving = financed
    while moving:
        rated = out.withColumn(
            "f", F.when(F.col("traded") > 0, F.col("grow_cash")).otherwise(F.col("grow_debt"))
        )
        # Interest of a bar applies to what was there before it, trades included, so
        # an amount paid in is discounted by the growth before its bar.
        grown = scans.running(
            rated.drop("cash"),
            ["run_id"],
            ["seq"],
            chunk,
            growth=scans.running_product(F.col("f")),
        )
        past = F.col("growth") / F.col("f")
        summed = scans.running(
            grown.withColumn("now", F.col("flow") / past - F.col("charge") / F.col("growth")),
            ["run_id"],
            ["seq"],
            chunk,
            kept=scans.running_sum(F.col("now")),
        )
        cash = F.col("growth") * (F.col("initial_cash") + F.col("kept"))
        before_interest = (cash + F.col("charge")) / F.col("f")
        made = durable(
            summed.withColumns({"cash": cash, "__traded": before_interest})
            .withColumn("__moved", (F.col("__traded") > 0) != (F.col("traded") > 0))
            .withColumn("traded", F.col("__traded"))
            .drop("__traded", "growth", "now", "kept", "f")
        )
        moving = not made.filter("__moved").isEmpty()
        out = made.drop("__moved")
    return out.join(line, "seq").select(
        "run_id", "seq", "ts", (F.col("cash") + F.col("held")).alias("equity"), "cash"
    )


# -- whole sweeps ----------------------------------------------------------------


def run_signals(panel: DataFrame, runs: Sequence[Run], length: Column | int) -> Signal:
    """Weights, decisions and warm-ups of all runs, one pass per kind of signal."""
    groups: dict[str, list[Run]] = {}
    for run in runs:
        groups.setdefault(run.signal.lower(), []).append(run)
    made = [signals.get_signal(name)(panel, members, length) for name, members in groups.items()]
    weights, decisions = made[0].weights, made[0].decisions
    for signal in made[1:]:
        weights = weights.unionByName(signal.weights)
        decisions = decisions.unionByName(signal.decisions)
    return Signal(weights, decisions, {r: n for signal in made for r, n in signal.warmups.items()})


class Sweep:
    """Results of a sweep.

    What several steps read (timeline, price grid, panel, weights, rebalances and
    their growth) is written once; equity, holdings and fills are lazy.
    """

    def __init__(
        self,
        bars: DataFrame,
        runs: Sequence[Run],
        timeframe: str | TimeFrame = "1Day",
        chunk_rows: int | None = None,
    ) -> None:
        if len({r.run_id for r in runs}) != len(runs):
            raise ValueError("run_id must be unique")
        if any(r.costs.min_commission for r in runs):
            raise ValueError(
                "a minimum commission depends on the size of each order: "
                "use lump_sum_buy or ledger_from_fills"
            )
        if any(r.initial_cash <= 0 or r.costs.borrow_rate < 0 for r in runs):
            raise ValueError("a sweep needs initial cash above zero and no negative borrow rate")
        self.timeframe = TimeFrame.of(timeframe) if isinstance(timeframe, str) else timeframe
        self.line = scans.timeline(bars)
        count = self.line.count()
        if count < 2:
            raise ValueError(f"need at least 2 bars, got {count}")
        # Series of bars stay whole below one limit; rebalances carry their orders
        # along and are cut earlier.
        self._bar_rows = chunk_rows or signals.chunk_for(count)
        self._order_rows = chunk_rows or (_ORDER_CHUNK if count > _ORDER_CHUNK else None)
        self.length = F.lit(count).cast("long")
        self.accounts = signals.account_frame(bars.sparkSession, runs)
        self.benchmarks = {r.run_id: r.benchmark for r in runs if r.benchmark}
        self.grid = durable(
            bar_ops.effective_open(bar_ops.dense_grid(bars, fields=("open",), line=self.line))
        )
        if not self.grid.filter("trade_price < 0 OR mark < 0").isEmpty():
            raise ValueError("prices must not be negative")
        panel = durable(bar_ops.with_seq(bars, self.line).select("symbol", "ts", "seq", "close"))
        signal = run_signals(panel, runs, count)
        self.decisions = signal.decisions
        self.weights = durable(normalise_weights(signal.weights, self.accounts))
        bar_ops.require_known_symbols(self.weights, panel)
        self._check_decisions(runs, signal.warmups, count)
        rebalances = durable(schedule_rebalances(signal.decisions, self.length, self._bar_rows))
        self.legs, self.growth = self._solved(rebalances)
        self._skip_ruined(rebalances)
        self.fills = fills_from_weights(self.growth, self.accounts, self.line)
        self.equity, self.holdings = self._marked(self.legs, self.growth, self.accounts)

    def _solved(self, rebalances: DataFrame) -> tuple[DataFrame, DataFrame]:
        legs = durable(legs_of(self.weights, rebalances, self.grid, self.length))
        lent = legs.filter("w < 0 AND e_next > e + 1").join(
            self.accounts.filter("borrow_rate <> 0"), "run_id", "left_semi"
        )
        if not lent.isEmpty():
            raise ValueError("a lent symbol without a price has no borrowing charge")
        growth = rebalance_growth(
            legs, rebalances, self.grid, self.accounts, self.timeframe, self._order_rows
        )
        return legs, growth

    def _marked(
        self, legs: DataFrame, growth: DataFrame, accounts: DataFrame
    ) -> tuple[DataFrame, DataFrame]:
        return mark_to_market(
            legs, growth, self.grid, accounts, self.line, self.length, self.timeframe, self._bar_rows
        )

    def _skip_ruined(self, rebalances: DataFrame) -> None:
        """Take the rebalances without equity out of the schedule and solve their runs again.

        The book held when equity runs out is marked to the end; the next rebalance that
        finds equity there is the next one to trade. Each round settles one such time per run.
        """
        while True:
            ruined = self.growth.filter("ruined").groupBy("run_id").agg(
                F.min("e").alias("e_end"), F.min("s").alias("s_end")
            )
            if ruined.isEmpty():
                return
            ruined = durable(ruined)
            last = F.col("e") == F.col("e_end") - 1
            book = self.legs.join(ruined, "run_id").filter("e < e_end")
            # What is still held when equity runs out stays to the end of the bars.
            open_ = F.col("e_next") >= F.col("e_end")
            book = book.withColumns(
                {
                    "s_next": F.when(open_, self.length).otherwise(F.col("s_next")),
                    "o_next": F.when(~open_, F.col("o_next")),
                }
            )
            spent = self.growth.join(ruined, "run_id").filter("e < e_end").withColumns(
                {
                    "s_next": F.when(last, self.length).otherwise(F.col("s_next")),
                    "turns": F.when(last, 1 - F.col("cost") - F.col("net") > 0).otherwise(F.col("turns")),
                }
            )
            accounts = self.accounts.join(ruined, "run_id", "left_semi")
            cash, _ = self._marked(book, spent, accounts)
            later = rebalances.join(ruined, "run_id").filter("s > s_end").select("run_id", "s")
            shares = book.filter(open_).join(
                spent.select("run_id", "e", "equity"), ["run_id", "e"]
            ).select("run_id", "symbol", (F.col("w") * F.col("equity") / F.col("o")).alias("shares"))
            prices = self.grid.select("symbol", F.col("seq").alias("s"), "trade_price")
            worth = (
                later.join(shares, "run_id").join(prices, ["symbol", "s"])
                .groupBy("run_id", "s").agg(F.sum(F.col("shares") * F.col("trade_price")).alias("worth"))
            )
            found = (
                later.join(cash.select("run_id", (F.col("seq") + 1).alias("s"), "cash"), ["run_id", "s"])
                .join(worth, ["run_id", "s"], "left")
                .filter(F.col("cash") + F.coalesce("worth", F.lit(0.0)) > 0)
                .groupBy("run_id").agg(F.min("s").alias("resume"))
            )
            skipped = ruined.join(found, "run_id", "left")
            keep = rebalances.join(skipped, "run_id", "left").filter(
                F.col("s_end").isNull() | (F.col("s") < F.col("s_end")) | (F.col("s") >= F.col("resume"))
            )
            rebalances = durable(_scheduled(keep.select("run_id", "s"), self.length, self._bar_rows))
            legs, growth = self._solved(rebalances.join(ruined, "run_id", "left_semi"))
            self.legs = durable(self.legs.join(ruined, "run_id", "left_anti").unionByName(legs))
            self.growth = durable(self.growth.join(ruined, "run_id", "left_anti").unionByName(growth))

    def _check_decisions(self, runs: Sequence[Run], warmups: dict[str, int], count: int) -> None:
        """Every bar after the signal's warm-up but the last one needs a decision."""
        given = self.accounts.sparkSession.createDataFrame(
            [(r.run_id, warmups.get(r.run_id, 0)) for r in runs], "run_id string, warmup long"
        )
        missing = missing_decisions(self.decisions, count, given).limit(20).collect()
        if missing:
            raise ValueError(f"runs without a decision on every bar: {sorted(r.run_id for r in missing)}")

    def equity_table(self) -> DataFrame:
        return equity_table(self.equity, self.holdings, self.fills, self.timeframe.chunk_seconds())

    def benchmark_returns(self, prices: DataFrame) -> DataFrame:
        """Returns (benchmark, ts, r) of the benchmarks that runs name, on the bars of the sweep.

        ``prices`` are (benchmark, ts, close); each series is aligned once, however many runs name it.
        """
        chunk = self.timeframe.chunk_seconds()
        names = sorted(set(self.benchmarks.values()))
        if not names:
            raise ValueError("no run names a benchmark")
        found = metrics.align_benchmark(self.line.select("ts"), prices, names, chunk)
        return found.select("benchmark", "ts", "r")

    def _benchmark_of(self) -> DataFrame:
        return self.accounts.sparkSession.createDataFrame(
            sorted(self.benchmarks.items()), "run_id string, benchmark string"
        )

    def benchmark_curves(self, prices: DataFrame) -> DataFrame:
        """What the initial cash of each run would be worth in its benchmark: run_id, ts, benchmark, equity."""
        growth = metrics.growth_curve(
            self.benchmark_returns(prices), ["benchmark"], self.timeframe.chunk_seconds()
        )
        runs = self._benchmark_of().join(self.accounts.select("run_id", "initial_cash"), "run_id")
        return growth.join(F.broadcast(runs), "benchmark").select(
            "run_id", "ts", "benchmark", (F.col("initial_cash") * F.col("growth")).alias("equity")
        )

    def stats(
        self, benchmark: DataFrame | None = None, prices: DataFrame | None = None
    ) -> DataFrame:
        """Performance and account statistics, one row per run.

        ``benchmark`` is one series (ts, r) for all runs. With ``prices`` (benchmark, ts, close)
        each run is compared with the benchmark that it names, and with none if it names none.
        """
        table = durable(self.equity_table())
        returns = table.select("run_id", "ts", F.col("returns").alias("r"))
        of = None
        if prices is not None:
            benchmark, of = durable(self.benchmark_returns(prices)), self._benchmark_of()
        stats = metrics.performance_stats(
            returns, self.timeframe, benchmark=benchmark, benchmark_of=of
        )
        return stats.join(metrics.run_stats(table, self.fills), "run_id")


def run_sweep(
    bars: DataFrame,
    runs: Sequence[Run],
    timeframe: str | TimeFrame = "1Day",
    chunk_rows: int | None = None,
) -> Sweep:
    """Run every row of a parameter table over the same bars."""
    return Sweep(bars, runs, timeframe, chunk_rows)
