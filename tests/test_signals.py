import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import make_bars, walk
from tidebar.operators import bars, portfolio, signals
from tidebar.operators.signals import Run


def walked(z, lookback, entry, leave, cap):
    """Holdings bar by bar for ``z[bar][symbol]``."""
    held, out = [], {}
    for i in range(lookback, len(z) - 1):
        row = {s: v for s, v in z[i].items() if v is not None}
        kept = [s for s in held if s in row and row[s] < leave]
        fresh = sorted((v, s) for s, v in row.items() if v < -entry and s not in kept)
        held = kept + [s for _, s in fresh[: max(0, cap - len(kept))]]
        out[i] = set(held)
    return out


@pytest.mark.parametrize("entry,leave,cap", [(0.5, 0.0, 2), (1.0, 0.8, 1), (-0.2, -0.4, 3), (0.8, 0.5, 9)])
def test_mean_reversion_equals_a_walk_over_the_bars(spark, entry, leave, cap):
    closes = {s: walk(90, seed=k, gaps=0.04)[1] for k, s in enumerate("ABCDE")}
    closes["A"] = walk(90, seed=9)[1]
    panel = bars.with_seq(make_bars(spark, closes, closes))
    levels = {"lookback": 6, "entry_z": entry, "exit_z": leave, "max_positions": cap}
    scores = signals.scored(panel, [(6, float(entry), float(leave))], 90)
    z = [{} for _ in range(90)]
    for r in scores.collect():
        z[r.seq][r.symbol] = r.z
    wanted = walked(z, 6, entry, leave, cap)
    made = signals.mean_reversion(panel, [Run("r", "mean_reversion", levels)], 90)
    got = {i: set() for i in wanted}
    for r in made.weights.collect():
        got[r.seq].add(r.symbol)
        assert r.weight == pytest.approx(1 / len(wanted[r.seq]))
    assert got == wanted
    assert made.decisions.count() == len(wanted)
    caps = spark.createDataFrame(
        [(6, float(entry), float(leave), cap)],
        "lookback int, entry_z double, exit_z double, max_positions int",
    )
    cut = {i: set() for i in wanted}
    for r in signals.capped_names(scores, caps, chunk_rows=5).collect():
        cut[r.seq].add(r.symbol)
    assert cut == wanted


def test_buy_and_hold_acts_once_and_rests(spark):
    frame = make_bars(spark, {"A": [None, 10.0, 11.0, 12.0], "B": [None, None, 5.0, 5.0], "C": [None] * 4})
    extra = make_bars(spark, {"D": [1.0] * 4}).withColumn("close", F.lit(None).cast("double"))
    panel = bars.with_seq(frame.unionByName(extra))
    runs = [Run("once", "buy_and_hold"), Run("each", "buy_and_hold", {"rebalance": True})]
    made = signals.buy_and_hold(panel, runs, 4)
    weights = sorted((r.run_id, r.seq, r.symbol, r.weight) for r in made.weights.collect())
    assert weights == [("each", 1, "A", 1.0), ("each", 2, "A", 0.5), ("each", 2, "B", 0.5), ("once", 1, "A", 1.0)]
    holds = {(r.run_id, r.seq): r.is_hold for r in made.decisions.collect()}
    assert holds == {
        ("once", 0): True, ("once", 1): False, ("once", 2): True,
        ("each", 0): True, ("each", 1): False, ("each", 2): False,
    }


def test_sma_cross_waits_for_its_warmup(spark):
    panel = bars.with_seq(make_bars(spark, {"A": [100 * 1.01**i for i in range(60)]}))
    made = signals.sma_cross(panel, [Run("r", "sma_cross", {"fast": 5, "slow": 20})], 60)
    assert made.weights.agg(F.min("seq"), F.max("seq")).first()[:] == (20, 58)
    with pytest.raises(ValueError):
        signals.sma_cross(panel, [Run("r", "sma_cross", {"fast": 20, "slow": 20})], 60)


def test_registry():
    assert signals.get_signal("SMA_Cross") is signals.sma_cross
    with pytest.raises(KeyError, match="momentum"):
        signals.get_signal("nothing")


def test_python_signal_sees_no_later_bar(spark):
    panel = bars.with_seq(make_bars(spark, {"A": [float(i) for i in range(1, 11)]}))
    out = signals.python_signal(panel, lambda past: past.max(axis=1), 3).orderBy("seq").collect()
    assert [r.score for r in out] == [None, None] + [float(i) for i in range(3, 11)]


def test_leverage_cap_and_missing_targets(spark):
    rows = [("r", 0, "A", 2.0), ("r", 0, "B", -2.0), ("r", 1, "A", float("nan")), ("r", 1, "B", 0.5)]
    weights = spark.createDataFrame(rows, "run_id string, seq long, symbol string, weight double")
    accounts = signals.account_frame(spark, [Run("r", "x", max_leverage=1.0)])
    got = {(r.seq, r.symbol): r.weight for r in portfolio.normalise_weights(weights, accounts).collect()}
    assert got == {(0, "A"): 0.5, (0, "B"): -0.5, (1, "B"): 0.5}


def test_sweep_needs_two_bars_and_known_symbols(spark):
    with pytest.raises(ValueError):
        portfolio.run_sweep(make_bars(spark, {"A": [1.0]}), [Run("r", "buy_and_hold")])
    frame = make_bars(spark, {"A": [1.0, 2.0]})
    targets = spark.createDataFrame([("Z",)], "symbol string")
    with pytest.raises(KeyError, match="Z"):
        bars.require_known_symbols(targets, frame)


def test_missing_decisions_are_found(spark):
    made = spark.createDataFrame([("r", 3), ("r", 4)], "run_id string, seq long")
    warmups = spark.createDataFrame([("r", 3), ("s", 8)], "run_id string, warmup int")
    got = portfolio.missing_decisions(made, 10, warmups).collect()
    assert {(r.run_id, r.expected, r.found) for r in got} == {("r", 6, 2), ("s", 1, 0)}


def _ahead(offset):
    """A signal that holds the symbols whose close ``offset`` bars on is above the present one."""

    def signal(panel, runs, length):
        other = F.lead("close", offset).over(Window.partitionBy("symbol").orderBy("seq"))
        rows = panel.withColumn("other", other).filter(F.col("seq") < length - 1)
        chosen = rows.filter("other > close").select(
            F.lit(runs[0].run_id).alias("run_id"), "seq", "symbol", F.lit(0.1).alias("weight")
        )
        every = rows.select(F.lit(runs[0].run_id).alias("run_id"), "seq", F.lit(False).alias("is_hold")).distinct()
        return signals.Signal(chosen, every)

    return signal


def test_signals_that_look_ahead_are_found(spark, monkeypatch):
    closes = {s: walk(40, seed=k)[1] for k, s in enumerate("ABCDE")}
    panel = bars.with_seq(make_bars(spark, closes))
    for name, offset in [("ahead", 1), ("far", 5), ("behind", -1)]:
        monkeypatch.setitem(signals._signals, name, _ahead(offset))
    for name in ("ahead", "far"):
        with pytest.raises(ValueError, match=f"later bars: {name}"):
            signals.require_causal(panel, [Run(name, name)], 40)
    own = [Run("b", "behind"), Run("s", "sma_cross", {"fast": 3, "slow": 8}), Run("m", "momentum", {"lookback": 5})]
    signals.require_causal(panel, own, 40)
    with pytest.raises(ValueError, match="within"):
        signals.require_causal(panel, own, 40, [40])


def test_a_signal_that_knows_the_mean_of_all_bars_is_found(spark, monkeypatch):
    def centred(panel, runs, length):
        mean = F.avg("close").over(Window.partitionBy("symbol"))
        rows = panel.withColumn("mean", mean).filter(F.col("seq") < length - 1)
        weights = rows.select(F.lit("c").alias("run_id"), "seq", "symbol", (F.col("mean") / 1e6).alias("weight"))
        return signals.Signal(weights, weights.select("run_id", "seq", F.lit(False).alias("is_hold")).distinct())

    monkeypatch.setitem(signals._signals, "centred", centred)
    panel = bars.with_seq(make_bars(spark, {s: walk(20, seed=k)[1] for k, s in enumerate("AB")}))
    with pytest.raises(ValueError, match="c \\(bar 0\\)"):
        signals.require_causal(panel, [Run("c", "centred")], 20)
