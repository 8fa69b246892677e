import pytest
from pyspark.sql import functions as F

from tests.conftest import make_bars, walk
from tests.ledger import account
from tidebar.operators import bars, portfolio, scans, signals
from tidebar.operators.signals import Costs, Run

COSTS = Costs(slippage_bps=5, commission_per_share=0.005, commission_bps=2)
FINANCED = Costs(
    slippage_bps=5, commission_per_share=0.005, commission_bps=2, cash_rate=0.04, borrow_rate=0.08
)


def panel(spark, n=120, symbols="ABC", gaps=0.0):
    opens, closes = {}, {}
    for k, s in enumerate(symbols):
        opens[s], closes[s] = walk(n, seed=10 + k, gaps=gaps)
    # The first bar of A keeps the timeline complete.
    return make_bars(spark, closes, opens), opens, closes


@signals.register("scripted")
def scripted(panel, runs, length):
    """Targets that change sign and size, with bars of rest in between."""
    spark = panel.sparkSession
    weights, decisions = [], []
    for run in runs:
        decisions += [(run.run_id, i, i not in run.params["script"]) for i in range(length - 1)]
        for i, w in run.params["script"].items():
            weights += [(run.run_id, i, s, float(x)) for s, x in w.items()]
    return signals.Signal(
        spark.createDataFrame(weights, "run_id string, seq long, symbol string, weight double"),
        spark.createDataFrame(decisions, "run_id string, seq long, is_hold boolean"),
    )


def script(n, every=1):
    out = {}
    for i in range(3, n - 1, every):
        a, b = ((i * 7) % 11 - 5) / 8, ((i * 5) % 13 - 6) / 9
        out[i] = {} if i % 17 == 0 else {"A": a, "B": b, "C": 0.2}
    return out


@pytest.mark.parametrize("chunk_rows", [None, 16])
@pytest.mark.parametrize(
    "costs,cap,every",
    [(COSTS, 1.0, 1), (Costs(slippage_bps=0), 1.0, 4), (FINANCED, 1.5, 1), (FINANCED, 1.5, 9)],
)
def test_equity_matches_sequential_account(spark, costs, cap, every, chunk_rows):
    frame, opens, closes = panel(spark)
    moves = script(120, every)
    run = Run("r", "scripted", {"script": moves}, costs, max_leverage=cap)
    sweep = portfolio.run_sweep(frame, [run], chunk_rows=chunk_rows)
    equity, cash, fills = account(opens, closes, moves, costs, cap=cap)
    got = {r.seq: r for r in sweep.equity.collect()}
    assert len(got) == 120
    for i in range(120):
        assert got[i].equity == pytest.approx(equity[i], rel=1e-9)
        assert got[i].cash == pytest.approx(cash[i], rel=1e-7, abs=1e-4)
    found = {(r.seq, r.symbol): r.shares for r in sweep.fills.collect()}
    wanted = {(i, s): q for i, s, q, _, _ in fills}
    assert found.keys() == wanted.keys()
    for key, q in wanted.items():
        assert found[key] == pytest.approx(q, rel=1e-6, abs=1e-7)


@pytest.mark.parametrize("chunk_rows", [None, 16])
def test_ledger_of_own_fills_reproduces_equity(spark, chunk_rows):
    frame, opens, closes = panel(spark, gaps=0.1)
    runs = [
        Run("plain", "scripted", {"script": script(120)}, COSTS),
        Run("financed", "scripted", {"script": script(120, 5)}, FINANCED, max_leverage=1.5),
    ]
    sweep = portfolio.run_sweep(frame, runs)
    ledger = portfolio.ledger_from_fills(
        sweep.fills, sweep.grid, sweep.accounts, sweep.line, sweep.length, chunk_rows=chunk_rows
    )
    both = ledger.select("run_id", "seq", F.col("equity").alias("e2")).join(
        sweep.equity, ["run_id", "seq"]
    )
    rows = both.collect()
    assert len(rows) == 240
    for r in rows:
        assert r.e2 == pytest.approx(r.equity, rel=1e-9)


def against_account(spark, opens, closes, runs, chunk_rows=None, rel=1e-12):
    """A sweep over scripted runs against the sequential account and against its own fills."""
    sweep = portfolio.run_sweep(make_bars(spark, closes, opens), runs, chunk_rows=chunk_rows)
    equity = {(r.run_id, r.seq): r for r in sweep.equity.collect()}
    fills = {(r.run_id, r.seq, r.symbol): r.shares for r in sweep.fills.collect()}
    ledger = portfolio.ledger_from_fills(
        sweep.fills, sweep.grid, sweep.accounts, sweep.line, sweep.length, chunk_rows=chunk_rows
    )
    booked = {(r.run_id, r.seq): r.equity for r in ledger.collect()}
    for run in runs:
        expected, cash, traded = account(
            opens, closes, run.params["script"], run.costs, cap=run.max_leverage
        )
        size = max(map(abs, expected))
        for i, (e, c) in enumerate(zip(expected, cash)):
            got = equity[run.run_id, i]
            assert got.equity == pytest.approx(e, rel=rel, abs=rel * size)
            assert got.cash == pytest.approx(c, rel=1e-9, abs=1e-9 * size)
            assert booked[run.run_id, i] == pytest.approx(e, rel=1e-9, abs=1e-9 * size)
        wanted = {(i, s): q for i, s, q, _, _ in traded}
        found = {(i, s): q for (r, i, s), q in fills.items() if r == run.run_id}
        assert found.keys() == wanted.keys()
        for key, q in wanted.items():
            assert found[key] == pytest.approx(q, rel=1e-7, abs=1e-6)
    return equity


def stretch(*parts):
    """A price that moves by a factor over so many bars, part after part."""
    out = [100.0]
    for bars, factor in parts:
        out += [out[-1] * factor ** ((i + 1) / bars) for i in range(bars)]
    return out


@pytest.mark.parametrize("chunk_rows", [None, 16])
def test_cash_that_turns_within_a_holding_period(spark, chunk_rows):
    """Charges on a short position eat up the cash, long before the next rebalance."""
    closes = {"A": stretch((20, 2.5), (60, 1.0)), "B": stretch((20, 0.5), (60, 1.1)), "C": [None] * 81}
    opens = {s: [None if c is None else c * 1.001 for c in v] for s, v in closes.items()}
    borrow = Costs(slippage_bps=5, cash_rate=0.03, borrow_rate=4.0)
    runs = [
        Run("turning", "scripted", {"script": {2: {"A": 1.2, "B": -0.4}, 70: {"A": 0.5}}}, borrow, max_leverage=2),
        Run("debt", "scripted", {"script": {2: {"A": 1.5, "B": -0.3}}}, borrow, max_leverage=2),
        Run("rich", "scripted", {"script": {2: {"B": -0.2}, 40: {"A": -0.4}}}, borrow, max_leverage=2),
    ]
    got = against_account(spark, opens, closes, runs, chunk_rows)
    signs = [got["turning", i].cash > 0 for i in range(3, 71)]
    assert signs[0] and not signs[-1] and signs == sorted(signs, reverse=True)
    assert got["debt", 3].cash < 0 < got["rich", 80].cash


@pytest.mark.parametrize("chunk_rows", [None, 16])
def test_rebalances_without_equity_are_skipped(spark, chunk_rows):
    """A run that loses everything, one that recovers on its held book, and one that does so twice."""
    path = stretch((10, 1.0), (6, 0.55), (10, 2.4), (10, 1.0), (6, 0.5), (10, 2.6), (10, 1.0))
    opens, closes = {"A": path, "B": stretch((62, 1.2))}, {"A": [p * 1.001 for p in path], "B": stretch((62, 1.2))}
    every = lambda w: {i: w for i in range(3, 62)}
    costs = Costs(slippage_bps=3, cash_rate=0.02, borrow_rate=0.06)
    runs = [
        Run("lost", "scripted", {"script": {3: {"A": 4.0}} | {i: {"B": 1.0} for i in range(20, 24)}}, costs, max_leverage=5),
        Run("back", "scripted", {"script": {5: {"A": 2.6}} | {i: {"A": 0.5, "B": 0.4} for i in range(14, 60, 3)}}, costs, max_leverage=5),
        Run("twice", "scripted", {"script": {5: {"A": 2.6}, 15: {"B": 1.0}, 30: {"A": 2.4}} | {i: {"B": 0.5} for i in range(40, 60)}}, costs, max_leverage=5),
        Run("sound", "scripted", {"script": every({"A": 0.4, "B": 0.4})}, costs),
    ]
    got = against_account(spark, opens, closes, runs, chunk_rows, rel=1e-10)
    assert any(got["lost", i].equity < 0 for i in range(63))
    assert any(got["twice", i].equity < 0 for i in range(12, 20)) and got["back", 62].equity > 0


@pytest.mark.parametrize("chunk_rows", [None, 16])
def test_high_costs_settle(spark, chunk_rows):
    _, opens, closes = panel(spark)
    costs = Costs(slippage_bps=1500, commission_per_share=0.4, commission_bps=200)
    moves = {i: {"A": 0.3 + 0.2 * (i % 3), "B": -0.2 * (i % 2), "C": 0.1} for i in range(3, 119)}
    against_account(spark, opens, closes, [Run("r", "scripted", {"script": moves}, costs)], chunk_rows, rel=1e-11)


@pytest.mark.parametrize("chunk_rows", [None, 16])
def test_a_price_of_zero_is_held_through(spark, chunk_rows):
    _, opens, closes = panel(spark, 60)
    for i in (20, 21, 22, 40):
        opens["A"][i] = closes["A"][i] = 0.0
    opens["B"][30] = 0.0  # its close is there
    for i in range(50, 60):
        opens["C"][i] = closes["C"][i] = 0.0  # worthless from there on
    every = {i: {"A": 0.3 + 0.1 * (i % 2), "B": 0.3, "C": 0.2} for i in range(3, 59)}
    runs = [
        Run("free", "scripted", {"script": every}, Costs(slippage_bps=0)),
        Run("costly", "scripted", {"script": every}, COSTS),
        Run("rare", "scripted", {"script": {5: {"A": 0.5, "B": 0.4}, 21: {"B": 0.5}, 39: {"A": 0.6}, 45: {}}}, FINANCED),
    ]
    against_account(spark, opens, closes, runs, chunk_rows)
    flat = portfolio.run_sweep(
        make_bars(spark, closes, opens), [Run("e", "buy_and_hold", {"rebalance": True})], chunk_rows=chunk_rows)
    assert flat.equity.filter("equity IS NULL OR isnan(equity)").isEmpty()
    with pytest.raises(ValueError, match="no borrowing charge"):
        short = Run("s", "scripted", {"script": {i: {"A": -0.3} for i in range(3, 59)}}, FINANCED)
        portfolio.run_sweep(make_bars(spark, closes, opens), [short])


def test_gaps_trade_at_the_last_close(spark):
    frame, opens, closes = panel(spark, gaps=0.15)
    moves = script(120)
    sweep = portfolio.run_sweep(frame, [Run("r", "scripted", {"script": moves}, COSTS)])
    equity, _, _ = account(opens, closes, moves, COSTS)
    got = {r.seq: r.equity for r in sweep.equity.collect()}
    assert [got[i] for i in range(len(got))] == pytest.approx(equity, rel=1e-9)


def test_signals_that_cannot_be_traded_are_refused(spark):
    frame, _, _ = panel(spark)
    with pytest.raises(KeyError, match="ZZZ"):
        portfolio.run_sweep(frame, [Run("a", "scripted", {"script": {3: {"ZZZ": 0.5}}}, COSTS)])
    costly = Costs(min_commission=5)
    with pytest.raises(ValueError, match="minimum commission"):
        portfolio.run_sweep(frame, [Run("a", "scripted", {"script": script(10)}, costly)])


@signals.register("forgetful")
def forgetful(given, runs, length):
    """Decides on every other bar only."""
    made = scripted(given, runs, length)
    return signals.Signal(made.weights, made.decisions.filter("seq % 2 = 0"))


def test_missing_decisions_are_refused(spark):
    frame, _, _ = panel(spark)
    with pytest.raises(ValueError, match="without a decision"):
        portfolio.run_sweep(frame, [Run("a", "forgetful", {"script": script(10)}, COSTS)])


@signals.register("silent")
def silent(given, runs, length):
    """Never decides, though it asked for three bars only."""
    made = scripted(given, runs, length)
    return signals.Signal(made.weights, made.decisions.filter("false"), {r.run_id: 3 for r in runs})


@signals.register("late")
def late(given, runs, length):
    """Begins twenty bars after the warm-up that it states."""
    made = scripted(given, runs, length)
    return signals.Signal(made.weights, made.decisions.filter("seq >= 23"), {r.run_id: 3 for r in runs})


@pytest.mark.parametrize("name", ["silent", "late"])
def test_runs_without_decisions_are_refused(spark, name):
    frame, _, _ = panel(spark, 40)
    runs = [Run("ok", "scripted", {"script": script(40)}), Run("gone", name, {"script": script(40)})]
    with pytest.raises(ValueError, match="gone"):
        portfolio.run_sweep(frame, runs)
    assert [r.run_id for r in portfolio.missing_decisions(
        spark.createDataFrame([], "run_id string, seq long, is_hold boolean"), 40,
        spark.createDataFrame([("a", 39), ("b", 38)], "run_id string, warmup long")).collect()] == ["b"]


def test_small_units_are_kept_and_closed_positions_are_not(spark):
    frame, _, _ = panel(spark, 20)
    sweep = portfolio.run_sweep(frame, [Run("r", "scripted", {"script": {3: {"A": 0.5}}}, Costs())])
    fills = sweep.fills.limit(0).union(spark.createDataFrame(
        [("r", None, 4, "A", "buy", 4e-10, 100.0, 100.0, 4e-8, 0.0, 0.0),
         ("r", None, 5, "B", "buy", 0.1, 100.0, 100.0, 10.0, 0.0, 0.0),
         ("r", None, 6, "B", "buy", 0.2, 100.0, 100.0, 20.0, 0.0, 0.0),
         ("r", None, 7, "B", "sell", -0.3, 100.0, 100.0, -30.0, 0.0, 0.0)], sweep.fills.schema))
    held = portfolio._positions_per_bar(fills, sweep.length, None).groupBy("symbol").count().collect()
    assert {r.symbol: r["count"] for r in held} == {"A": 16, "B": 2}
