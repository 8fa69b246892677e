"""Queries on signals, accounting and sweeps."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidebar.operators import bars, metrics, portfolio, report, scans, signals
from tidebar.operators.signals import Costs, Run
from tidebar.plans import fixtures as fx
from tidebar.plans.metric_queries import stats_tables
from tidebar.plans.registry import cents, query, shown
from tidebar.plans.sql import money, rnd, with_tables
from tidebar.session import scratch_folder
from tidebar.sources import tables

# -- settings of the registered runs ---------------------------------------------

_COSTLY = Costs(slippage_bps=5, commission_per_share=0.005, commission_bps=2)
_FINANCED = Costs(
    slippage_bps=5,
    commission_per_share=0.005,
    commission_bps=2,
    cash_rate=0.04,
    borrow_rate=0.08,
)

RUNS = [
    Run("hold", "buy_and_hold", {"gross": 0.9}, _COSTLY),
    Run("even", "buy_and_hold", {"rebalance": True}, Costs()),
    Run("trend", "sma_cross", {"fast": 3, "slow": 8}, _COSTLY),
    Run(
        "spread",
        "sma_cross",
        {"fast": 3, "slow": 8, "long_short": True, "gross": 1.6},
        _FINANCED,
        50_000.0,
        1.4,
    ),
    Run("slow", "sma_cross", {"fast": 5, "slow": 12, "gross": 0.5}, _FINANCED),
    Run("dip", "mean_reversion", {"lookback": 6, "entry_z": 0.8, "exit_z": 0.2, "max_positions": 25}, _COSTLY),
    Run("few", "mean_reversion", {"lookback": 6, "entry_z": 0.8, "exit_z": 0.2, "max_positions": 3}, _COSTLY),
    Run("best", "momentum", {"lookback": 6}, _FINANCED),
]


def _of(kind: str) -> list[Run]:
    return [r for r in RUNS if r.signal == kind]


def _window(fn: str, n: int) -> str:
    w = f"(PARTITION BY symbol ORDER BY seq RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) OVER {w} = {n} THEN {fn}(close) OVER {w} END"


def _every(run: str, first: int, hold: str = "false") -> str:
    return (
        f"SELECT '{run}' AS run_id, seq, {hold} AS is_hold FROM calm_month_line "
        f"WHERE seq >= {first} AND seq < (SELECT max(seq) FROM calm_month_line)"
    )


def _cross(run: str, fast: int, slow: int, gross: float, both: bool) -> str:
    total = f"{gross / 2 if both else gross!r}::DOUBLE"
    sign = "way" if both else "1"
    keep = "" if both else "AND way = 1"
    return f"""
    SELECT '{run}' AS run_id, seq, symbol,
      {sign} * {total} / count(*) OVER (PARTITION BY seq, way) AS weight
    FROM (SELECT symbol, seq, CASE WHEN f > s THEN 1 ELSE -1 END AS way FROM (
      SELECT symbol, seq, {_window('avg', fast)} AS f, {_window('avg', slow)} AS s FROM calm_panel)
      WHERE f IS NOT NULL AND s IS NOT NULL)
    WHERE seq >= {slow} AND seq < (SELECT max(seq) FROM calm_month_line) {keep}"""


_SIGNAL_TABLES = {
    "month_z": (
        f"SELECT symbol, seq, (close - {_window('avg', 6)}) / nullif({_window('stddev_samp', 6)}, 0) "
        "AS z FROM calm_panel"
    ),
    "dips": """
      SELECT seq, coalesce(list(symbol) FILTER (z < 0.2), []) AS keepable,
        coalesce(list(symbol ORDER BY z, symbol) FILTER (z < -0.8), []) AS enter
      FROM month_z WHERE seq >= 6 AND seq < (SELECT max(seq) FROM calm_month_line) GROUP BY seq""",
    "walk": """
      SELECT run_id, cap, 5::BIGINT AS seq, []::VARCHAR[] AS held
      FROM (VALUES ('dip', 25), ('few', 3)) caps(run_id, cap)
      UNION ALL
      SELECT run_id, cap, seq, list_concat(kept, fresh[1:greatest(0, cap - len(kept))])
      FROM (SELECT *, list_filter(enter, lambda s: NOT list_contains(kept, s)) AS fresh
        FROM (SELECT w.run_id, w.cap, d.seq, d.enter,
          list_filter(w.held, lambda s: list_contains(d.keepable, s)) AS kept
          FROM walk w JOIN dips d ON d.seq = w.seq + 1))""",
    "gains": """
      SELECT symbol, seq, close / max(close) OVER (PARTITION BY symbol ORDER BY seq
        RANGE BETWEEN 5 PRECEDING AND 5 PRECEDING) - 1 AS gain FROM calm_panel""",
    "hold_targets": (
        "SELECT 'hold' AS run_id, seq, symbol, 0.9e0 / count(*) OVER () AS weight FROM calm_panel "
        "WHERE seq = (SELECT min(seq) FROM calm_panel WHERE close IS NOT NULL) AND close IS NOT NULL"
    ),
    "even_targets": (
        "SELECT 'even' AS run_id, seq, symbol, 1e0 / count(*) OVER (PARTITION BY seq) AS weight "
        "FROM calm_panel WHERE close IS NOT NULL AND seq < (SELECT max(seq) FROM calm_month_line)"
    ),
    "trend_targets": _cross("trend", 3, 8, 1.0, False),
    "spread_targets": _cross("spread", 3, 8, 1.6, True),
    "slow_targets": _cross("slow", 5, 12, 0.5, False),
    "dip_targets": (
        "SELECT run_id, seq, unnest(held) AS symbol, 1e0 / len(held) AS weight FROM walk "
        "WHERE len(held) > 0"
    ),
    "best_targets": """
      SELECT 'best' AS run_id, seq, arg_min(symbol, (-gain, symbol)) AS symbol, 1e0 AS weight
      FROM gains WHERE gain IS NOT NULL AND seq >= 6 AND seq % 21 = 0
        AND seq < (SELECT max(seq) FROM calm_month_line) GROUP BY seq""",
    "targets": " UNION ALL ".join(
        f"SELECT * FROM {n}_targets"
        for n in ("hold", "even", "trend", "spread", "slow", "dip", "best")
    ),
    "decided": " UNION ALL ".join(
        [
            _every("hold", 0, "seq <> (SELECT min(seq) FROM hold_targets)"),
            _every("even", 0),
            _every("trend", 8),
            _every("spread", 8),
            _every("slow", 12),
            _every("dip", 6),
            _every("few", 6),
            _every("best", 6, "seq % 21 <> 0"),
        ]
    ),
}


def _accounts_sql(runs: list[Run]) -> str:
    rows = ", ".join(
        f"('{r.run_id}', {r.initial_cash!r}::DOUBLE, {r.max_leverage!r}::DOUBLE, "
        + ", ".join(
            f"{float(getattr(r.costs, n))!r}::DOUBLE"
            for n in ("slippage_bps", "commission_per_share", "commission_bps", "cash_rate", "borrow_rate")
        )
        + ")"
        for r in runs
    )
    return (
        f"SELECT * FROM (VALUES {rows}) a(run_id, initial_cash, cap, slip, per_share, bps, "
        "cash_rate, borrow_rate)"
    )


# A sequential account in SQL: one recursion step per bar.
_LEDGER_TABLES = {
    **_SIGNAL_TABLES,
    "accounts": _accounts_sql(RUNS),
    "scaled": """
      SELECT run_id, seq, symbol, weight * CASE WHEN gross > cap THEN cap / gross ELSE 1 END AS weight
      FROM (SELECT *, sum(abs(weight)) OVER (PARTITION BY run_id, seq) AS gross
        FROM targets JOIN accounts USING (run_id))""",
    "names": "SELECT DISTINCT symbol FROM calm_months",
    "wanted": """
      SELECT d.run_id, d.seq, list(coalesce(w.weight, 0) ORDER BY n.symbol) AS ws
      FROM (SELECT * FROM decided WHERE NOT is_hold) d, names n
      LEFT JOIN scaled w ON w.run_id = d.run_id AND w.seq = d.seq AND w.symbol = n.symbol
      GROUP BY d.run_id, d.seq""",
    "steps": """
      SELECT seq, list(coalesce(open, prev_mark) ORDER BY symbol) AS opens,
        list(coalesce(mark, 0) ORDER BY symbol) AS marks,
        list(coalesce(prev_mark, 0) ORDER BY symbol) AS befores,
        range(1, count(*) + 1) AS idx, list(symbol ORDER BY symbol) AS syms
      FROM calm_cells GROUP BY seq""",
    "ledger": """
      SELECT run_id, -1::BIGINT AS seq, initial_cash AS cash,
        list_transform(range((SELECT count(*) FROM names)), lambda i: 0e0) AS pos,
        list_transform(range((SELECT count(*) FROM names)), lambda i: 0e0) AS old
      FROM accounts
      UNION ALL
      SELECT run_id, seq,
        paid * (1 + CASE WHEN paid > 0 THEN cash_rate ELSE borrow_rate END / 12)
          - coalesce(list_sum(list_transform(idx, lambda i:
              CASE WHEN pos[i] < 0 THEN -pos[i] * befores[i] ELSE 0e0 END)), 0) * borrow_rate / 12 AS cash,
        pos, old
      FROM (SELECT *, cash - list_sum(list_transform(idx, lambda i:
          CASE WHEN pos[i] = old[i] THEN 0e0 ELSE
            (pos[i] - old[i]) * opens[i] * (1 + sign(pos[i] - old[i]) * slip / 10000)
            + abs(pos[i] - old[i]) * per_share
            + abs((pos[i] - old[i]) * opens[i] * (1 + sign(pos[i] - old[i]) * slip / 10000)) * bps / 10000
          END)) AS paid
        FROM (SELECT *, CASE WHEN ws IS NULL OR base <= 0 THEN old ELSE list_transform(idx, lambda i:
            CASE WHEN coalesce(opens[i], 0) <= 0 THEN old[i] ELSE ws[i] * base / opens[i] END) END AS pos
          FROM (SELECT *, cash + list_sum(list_transform(idx, lambda i:
                old[i] * coalesce(opens[i], 0e0))) AS base
            FROM (SELECT l.run_id, b.seq, l.cash, l.pos AS old, b.opens, b.befores, b.idx, t.ws,
                a.slip, a.per_share, a.bps, a.cash_rate, a.borrow_rate
              FROM ledger l JOIN steps b ON b.seq = l.seq + 1
              JOIN accounts a ON a.run_id = l.run_id
              LEFT JOIN wanted t ON t.run_id = l.run_id AND t.seq = l.seq))))""",
    "booked": """
      SELECT l.run_id, l.seq, m.ts, l.cash, l.pos, l.old, s.opens, s.marks, s.syms, s.idx,
        l.cash + list_sum(list_transform(s.idx, lambda i: l.pos[i] * s.marks[i])) AS equity
      FROM ledger l JOIN steps s USING (seq) JOIN calm_month_line m USING (seq)""",
    "held": """
      SELECT run_id, ts, syms[i] AS symbol, pos[i] AS shares, pos[i] * marks[i] / equity AS weight
      FROM (SELECT *, unnest(idx) AS i FROM booked) WHERE abs(pos[i]) > 1e-9""",
    "filled": """
      SELECT run_id, ts, symbol, CASE WHEN shares > 0 THEN 'buy' ELSE 'sell' END AS side, shares, price,
        reference_price, shares * price AS notional,
        abs(shares) * per_share + abs(shares * price) * bps / 10000 AS commission,
        abs(shares) * abs(price - reference_price) AS slippage_cost
      FROM (SELECT run_id, ts, syms[i] AS symbol, pos[i] - old[i] AS shares, opens[i] AS reference_price,
          opens[i] * (1 + sign(pos[i] - old[i]) * slip / 10000) AS price, per_share, bps
        FROM (SELECT *, unnest(idx) AS i FROM booked JOIN accounts USING (run_id)))
      WHERE abs(shares) > 1e-6""",
    "curve": """
      SELECT run_id, ts, equity, cash,
        coalesce(equity / lag(equity) OVER (PARTITION BY run_id ORDER BY ts) - 1, 0) AS returns,
        equity / max(equity) OVER (PARTITION BY run_id ORDER BY ts) - 1 AS drawdown,
        coalesce(gross, 0) AS gross_exposure, coalesce(net, 0) AS net_exposure,
        coalesce(traded / equity, 0) AS turnover
      FROM booked
      LEFT JOIN (SELECT run_id, ts, sum(abs(weight)) AS gross, sum(weight) AS net FROM held GROUP BY 1, 2)
        USING (run_id, ts)
      LEFT JOIN (SELECT run_id, ts, sum(abs(shares) * price) AS traded FROM filled GROUP BY 1, 2)
        USING (run_id, ts)""",
}


def _ledger_sql(body: str, **extra: str) -> str:
    return with_tables(body, recursive=True, **{**_LEDGER_TABLES, **extra})


def _panel(spark, sf):
    months = fx.calm(fx.brand_months(spark, sf))
    line = scans.timeline(months)
    return bars.with_seq(months, line), line.agg(F.max("seq") + 1).scalar()


def _weights(spark, sf, kind):
    panel, length = _panel(spark, sf)
    return signals.get_signal(kind)(panel, _of(kind), length)


def _weights_sql(*names: str) -> str:
    body = " UNION ALL ".join(f"SELECT * FROM {n}_targets" for n in names)
    return with_tables(
        f"SELECT run_id, seq, symbol, {rnd('weight')} FROM ({body})",
        recursive=True,
        **_SIGNAL_TABLES,
    )


# -- runs whose cash turns or whose equity runs out ---------------------------------


@signals.register("hedged")
def hedged(panel, runs, length):
    """Buys the first half of the brands and sells the others, again after every so many bars."""
    spark = panel.sparkSession
    params = spark.createDataFrame(
        [(r.run_id, float(r.params["long"]), float(r.params["short"]), r.params["every"]) for r in runs],
        "run_id string, long double, short double, every long",
    )
    priced = panel.filter(F.col("close").isNotNull() & (F.col("seq") < length - 1)).select("symbol", "seq")
    side = F.when(F.col("symbol") < "Brand#3", 1).otherwise(-1)
    shared = signals.equal_weight(priced.withColumn("side", side), ["seq", "side"], F.lit(1.0))
    weight = F.when(F.col("side") > 0, F.col("long")).otherwise(-F.col("short")) * F.col("weight")
    weights = signals.per_run(shared, params).filter(F.col("seq") % F.col("every") == 0)
    bars_ = spark.range(length - 1).withColumnRenamed("id", "seq")
    return signals.Signal(
        weights.select("run_id", "seq", "symbol", weight.alias("weight")),
        signals.per_run(bars_, params).select("run_id", "seq", (F.col("seq") % F.col("every") != 0).alias("is_hold")),
    )


_LENT = Costs(5, 0.005, 2, 0.0, 0.01, 0.3)

#: Charges on the short side turn the cash of ``hedge`` and ``again`` and use up the equity of ``ruin``,
#: whose later rebalances are skipped.
EDGE_RUNS = [
    Run("hedge", "hedged", {"long": 0.9, "short": 0.3, "every": 100}, _LENT, 100_000.0, 1.5),
    Run("again", "hedged", {"long": 0.8, "short": 0.6, "every": 30}, Costs(300, 0, 0, 0.0, 0.01, 0.5), 100_000.0, 1.5),
    Run("ruin", "hedged", {"long": 0.9, "short": 8.0, "every": 20}, _LENT, 100_000.0, 9.0),
]


def _hedged_sql(run: Run) -> str:
    p = run.params
    return (
        f"SELECT '{run.run_id}' AS run_id, seq, symbol, CASE WHEN symbol < 'Brand#3' THEN {p['long']}::DOUBLE "
        f"ELSE -{p['short']}::DOUBLE END / count(*) OVER (PARTITION BY seq, symbol < 'Brand#3') AS weight "
        f"FROM calm_panel WHERE seq % {p['every']} = 0 AND close IS NOT NULL "
        "AND seq < (SELECT max(seq) FROM calm_month_line)"
    )


def _edge_sql(body: str) -> str:
    return _ledger_sql(
        body,
        accounts=_accounts_sql(EDGE_RUNS),
        targets=" UNION ALL ".join(map(_hedged_sql, EDGE_RUNS)),
        decided=" UNION ALL ".join(_every(r.run_id, 0, f"seq % {r.params['every']} <> 0") for r in EDGE_RUNS),
    )


_EDGE = _edge_sql("SELECT run_id, ts, " + rnd("equity", None, 2) + ", " + rnd("cash", None, 2) + " FROM booked")


@query(_EDGE)
def turning_and_ruined_runs(spark, sf):
    months = fx.calm(fx.brand_months(spark, sf))
    return shown(portfolio.run_sweep(months, EDGE_RUNS, "1Month").equity.drop("seq"), 2)


@query(_EDGE)
def ledger_of_turning_and_ruined_runs(spark, sf):
    """Their fills, booked again one by one."""
    months = fx.calm(fx.brand_months(spark, sf))
    sweep = portfolio.run_sweep(months, EDGE_RUNS, "1Month")
    out = portfolio.ledger_from_fills(
        sweep.fills, sweep.grid, sweep.accounts, sweep.line, sweep.length, "1Month"
    )
    return shown(out.select("run_id", "ts", "equity", "cash"), 2)


# -- signals -----------------------------------------------------------------------


@query(_weights_sql("hold", "even"))
def buy_and_hold_weights(spark, sf):
    return shown(_weights(spark, sf, "buy_and_hold").weights)


@query(_weights_sql("trend", "spread", "slow"))
def sma_cross_weights(spark, sf):
    return shown(_weights(spark, sf, "sma_cross").weights)


@query(_weights_sql("dip"))
def mean_reversion_weights(spark, sf):
    """Two runs of the same levels, of which one hits its cap on positions."""
    return shown(_weights(spark, sf, "mean_reversion").weights)


@query(
    with_tables(
        "SELECT run_id, cut, count(*) AS compared, 0::BIGINT AS differing FROM ("
        "SELECT run_id, seq FROM targets UNION ALL SELECT run_id, seq FROM decided), "
        "(SELECT unnest([count(*) // 3, 2 * count(*) // 3])::INT AS cut FROM calm_month_line) "
        "WHERE seq < cut AND run_id <> 'few' GROUP BY run_id, cut",
        recursive=True,
        **_SIGNAL_TABLES,
    )
)
def causal_signals(spark, sf):
    """Decisions of the runs before two cuts, against those made with another future."""
    panel, _ = _panel(spark, sf)
    length = panel.agg(F.max("seq")).first()[0] + 1
    runs = [r for r in RUNS if r.run_id != "few"]
    pairs = signals.compared_prefixes(panel, runs, length, [length // 3, 2 * length // 3])
    return pairs.groupBy("run_id", "cut").agg(
        F.count(F.lit(1)).alias("compared"), F.count_if("differs").alias("differing")
    )


@query(_weights_sql("best"))
def momentum_weights(spark, sf):
    return shown(_weights(spark, sf, "momentum").weights)


@query(
    with_tables(
        "SELECT run_id, seq, is_hold FROM decided", recursive=True, **_SIGNAL_TABLES
    )
)
def decisions(spark, sf):
    panel, length = _panel(spark, sf)
    return portfolio.run_signals(panel, RUNS, length).decisions


@query(
    with_tables(
        f"SELECT symbol, seq, {rnd('CASE WHEN n = 4 THEN close / mean - 1 END', 'score')} FROM "
        "(SELECT symbol, seq, close, count(close) OVER w AS n, avg(close) OVER w AS mean FROM calm_panel "
        "WINDOW w AS (PARTITION BY symbol ORDER BY seq RANGE BETWEEN 3 PRECEDING AND CURRENT ROW))"
    )
)
def python_scores(spark, sf):
    panel, _ = _panel(spark, sf)
    out = signals.python_signal(panel, lambda past: past["lag_0"] / past.mean(axis=1) - 1, 4)
    return shown(out.select("symbol", "seq", "score"))


@query(
    _ledger_sql(
        "SELECT run_id, seq, array_to_string(list(symbol ORDER BY symbol), ',') AS symbols FROM "
        "(SELECT DISTINCT run_id, seq, symbol FROM (SELECT run_id, seq, symbol FROM dip_targets "
        "UNION ALL SELECT run_id, seq + 1, symbol FROM dip_targets)) GROUP BY run_id, seq"
    )
)
def names_kept_or_new(spark, sf):
    """Union of the names held on a bar and on the bar before."""
    held = _weights(spark, sf, "mean_reversion").weights.select("run_id", "seq", "symbol")
    now = held.groupBy("run_id", "seq").agg(F.collect_set("symbol").alias("now"))
    past = now.select("run_id", (F.col("seq") + 1).alias("seq"), F.col("now").alias("past"))
    none = F.array().cast("array<string>")
    both = now.join(past, ["run_id", "seq"], "full").withColumn(
        "symbols", F.array_union(F.coalesce("past", none), F.coalesce("now", none))
    )
    return both.select(
        "run_id", "seq", F.array_join(F.array_sort("symbols"), ",").alias("symbols")
    )


@query(
    "SELECT DISTINCT "
    "p_type || '(brand=' || p_brand || ', size=' || p_size || ')' AS label FROM part"
)
def run_labels(spark, sf):
    params = F.create_map(
        F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")
    )
    return (
        fx.table(spark, sf, "part")
        .select(signals.run_label(F.col("p_type"), params).alias("label"))
        .distinct()
    )


# -- accounting --------------------------------------------------------------------


def _sweep(spark, sf) -> portfolio.Sweep:
    months = fx.calm(fx.brand_months(spark, sf))
    return portfolio.run_sweep(months, RUNS, "1Month")


@query(_ledger_sql(f"SELECT run_id, seq, symbol, {rnd('weight')} FROM scaled"))
def leveraged_weights(spark, sf):
    panel, length = _panel(spark, sf)
    raw = portfolio.run_signals(panel, RUNS, length).weights
    return shown(portfolio.normalise_weights(raw, signals.account_frame(spark, RUNS)))


@query(
    with_tables(
        "SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS e, seq + 1 AS s, "
        "coalesce(lead(seq + 1) OVER (PARTITION BY run_id ORDER BY seq), "
        "(SELECT max(seq) + 1 FROM calm_month_line)) AS s_next FROM decided WHERE NOT is_hold",
        recursive=True,
        **_SIGNAL_TABLES,
    )
)
def rebalances(spark, sf):
    panel, length = _panel(spark, sf)
    made = portfolio.run_signals(panel, RUNS, length).decisions
    return portfolio.schedule_rebalances(made, length, chunk_rows=10)


@query(
    _ledger_sql(
        "SELECT run_id, ts, " + ", ".join(
            rnd(c, None, 2 if c in ("equity", "cash") else 6)
            for c in ("equity", "cash", "returns", "drawdown", "gross_exposure", "net_exposure", "turnover")
        ) + " FROM curve"
    )
)
def sweep_equity(spark, sf):
    return shown(_sweep(spark, sf).equity_table(), equity=2, cash=2)


@query(
    _ledger_sql(
        f"SELECT run_id, ts, symbol, {rnd('shares', None, 4)}, {rnd('weight')} FROM held"
    )
)
def sweep_holdings(spark, sf):
    return shown(_sweep(spark, sf).holdings.drop("seq"), shares=4)


@query(
    _ledger_sql(
        "SELECT run_id, ts, symbol, side, " + ", ".join(
            rnd(c, None, 3)
            for c in ("shares", "price", "reference_price", "notional", "commission", "slippage_cost")
        ) + " FROM filled"
    )
)
def sweep_fills(spark, sf):
    return shown(_sweep(spark, sf).fills.drop("seq"), 3)


_CURVE_RETURNS = "SELECT run_id, ts, returns AS r FROM curve"
_RUN_COLUMNS = [
    "periods", "total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown",
    "max_drawdown_bars", "win_rate", "profit_factor", "best_period", "worst_period",
]


@query(
    _ledger_sql(
        "SELECT s.run_id, " + ", ".join(rnd(f"s.{c}", c, 5) for c in _RUN_COLUMNS) + ", "
        + rnd("CASE WHEN s.max_drawdown = 0 THEN 0 ELSE s.cagr / abs(s.max_drawdown) END", "calmar", 5)
        + ", " + rnd("var_95", None, 5) + ", " + rnd("cvar_95", None, 5) + ", "
        + rnd("trades", None, 5) + ", " + rnd("avg_turnover", None, 5) + ", "
        + rnd("total_commission", None, 3) + ", " + rnd("total_slippage", None, 3) + ", "
        + rnd("final_equity", None, 2)
        + " FROM stat s JOIN tails USING (run_id) JOIN tail_means USING (run_id) "
        "JOIN (SELECT run_id, avg(turnover) AS avg_turnover, arg_max(equity, ts) AS final_equity "
        "FROM curve GROUP BY run_id) USING (run_id) "
        "JOIN (SELECT run_id, count(*)::DOUBLE AS trades, sum(commission) AS total_commission, "
        "sum(slippage_cost) AS total_slippage FROM filled GROUP BY run_id) USING (run_id)",
        **stats_tables(_CURVE_RETURNS, 12.0),
    )
)
def sweep_statistics(spark, sf):
    stats = _sweep(spark, sf).stats()
    return shown(stats, 5, total_commission=3, total_slippage=3, final_equity=2)


# -- runs and their benchmarks -------------------------------------------------------

#: Brands that runs are compared with; ``slow`` has none, ``best`` one without any price.
_COMPARED = {
    "hold": "Brand#11", "even": "Brand#22", "trend": "Brand#11", "spread": "Brand#33", "dip": "Brand#22",
    "few": "Brand#33", "best": "Brand#99",
}

#: Benchmark prices leave out every third bar, which is filled, and have bars of their own, which are dropped.
_BENCHMARK_TABLES = {
    "compared": "SELECT * FROM (VALUES "
    + ", ".join(f"('{r}', '{b}')" for r, b in _COMPARED.items())
    + ") v(run_id, benchmark)",
    "bench_filled": """
      SELECT benchmark, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY benchmark ORDER BY ts) AS close
      FROM (SELECT DISTINCT benchmark FROM compared), calm_month_line
      LEFT JOIN (SELECT symbol, seq, close FROM calm_panel WHERE seq % 3 <> 1) p
        ON p.symbol = benchmark AND p.seq = calm_month_line.seq""",
    "bench_returns": """
      SELECT benchmark, ts, coalesce(close / lag(close) OVER (PARTITION BY benchmark ORDER BY ts) - 1, 0) AS b
      FROM bench_filled""",
    "bench_stats": """
      SELECT benchmark, product(1 + b) - 1 AS total, CASE WHEN max(b) > min(b)
        THEN avg(b) / stddev_samp(b) * sqrt(12e0) ELSE 0 END AS sharpe FROM bench_returns GROUP BY benchmark""",
    "bench_fits": """
      SELECT run_id, benchmark, CASE WHEN max(b) > min(b) THEN covar_samp(r, b) / var_samp(b) END AS beta,
        avg(r) AS mr, avg(b) AS mb
      FROM rs JOIN compared USING (run_id) JOIN bench_returns USING (benchmark, ts) GROUP BY run_id, benchmark""",
}


def _compared_sweep(spark, sf):
    months = fx.calm(fx.brand_months(spark, sf))
    runs = [replace(r, benchmark=_COMPARED.get(r.run_id)) for r in RUNS]
    panel = bars.with_seq(months, scans.timeline(months))
    prices = panel.filter("seq % 3 <> 1").select(F.col("symbol").alias("benchmark"), "ts", "close")
    off = prices.select("benchmark", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), (F.col("close") * 9).alias("close"))
    return portfolio.run_sweep(months, runs, "1Month"), prices.unionByName(off)


@query(
    _ledger_sql(
        "SELECT s.run_id, f.benchmark, " + rnd("s.total_return", "total_return", 5) + ", "
        + rnd("CASE WHEN f.run_id IS NOT NULL THEN coalesce(f.beta, 0) END", "beta", 5) + ", "
        + rnd("CASE WHEN f.run_id IS NOT NULL THEN coalesce((f.mr - f.beta * f.mb) * 12, 0) END", "alpha", 5) + ", "
        + rnd("b.total", "benchmark_return", 5) + ", " + rnd("b.sharpe", "benchmark_sharpe", 5) + ", "
        + rnd("s.total_return - b.total", "excess_return", 5)
        + " FROM stat s LEFT JOIN bench_fits f USING (run_id) LEFT JOIN bench_stats b USING (benchmark)",
        **stats_tables(_CURVE_RETURNS, 12.0),
        **_BENCHMARK_TABLES,
    )
)
def sweep_benchmark_statistics(spark, sf):
    """Each run against the benchmark that it names."""
    sweep, prices = _compared_sweep(spark, sf)
    stats = sweep.stats(prices=prices).join(sweep._benchmark_of(), "run_id", "left")
    return shown(
        stats.select(
            "run_id", "benchmark", "total_return", "beta", "alpha", "benchmark_return", "benchmark_sharpe",
            "excess_return",
        ),
        5,
    )


@query(
    _ledger_sql(
        "SELECT run_id, ts, benchmark, " + rnd("initial_cash * product(1 + b) OVER "
        "(PARTITION BY run_id ORDER BY ts)", "equity", 3)
        + " FROM compared JOIN accounts USING (run_id) JOIN bench_returns USING (benchmark)",
        **_BENCHMARK_TABLES,
    )
)
def sweep_benchmark_curves(spark, sf):
    """Initial cash held in the benchmark of each run."""
    sweep, prices = _compared_sweep(spark, sf)
    return shown(sweep.benchmark_curves(prices), 3)


@query(
    _ledger_sql(
        "SELECT run_id, ts, " + rnd("equity", None, 2) + ", " + rnd("cash", None, 2) + " FROM booked"
    )
)
def ledger_of_sweep_fills(spark, sf):
    """The fills of all runs, booked again one by one."""
    sweep = _sweep(spark, sf)
    out = portfolio.ledger_from_fills(
        sweep.fills, sweep.grid, sweep.accounts, sweep.line, sweep.length, "1Month"
    )
    return shown(out.select("run_id", "ts", "equity", "cash"), 2)


@query(
    _ledger_sql(
        "SELECT run_id, ts, symbol, side, " + ", ".join(
            rnd(c, None, 3)
            for c in ("shares", "price", "reference_price", "notional", "commission", "slippage_cost")
        ) + " FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, run_id DESC, symbol DESC) AS k "
        "FROM filled) WHERE k <= 10"
    )
)
def last_ten_fills(spark, sf):
    return shown(report.last_fills(_sweep(spark, sf).fills.drop("seq"), 10), 3)


@query(
    _ledger_sql(
        "SELECT run_id, ts, " + rnd("gross_exposure") + ", " + rnd("net_exposure")
        + " FROM curve JOIN (SELECT DISTINCT run_id, ts FROM held) USING (run_id, ts)"
    )
)
def exposures(spark, sf):
    return shown(metrics.exposure(_sweep(spark, sf).holdings))


@query(
    _ledger_sql(
        "SELECT run_id, symbol, count(*) AS fills, " + rnd("sum(shares)", "shares", 3)
        + " FROM filled WHERE run_id IN ('trend', 'best') GROUP BY run_id, symbol"
    )
)
def fills_of_some_runs(spark, sf):
    """Two runs read from the result tables of a sweep; the files of others are skipped."""
    sweep = _sweep(spark, sf)
    folder = scratch_folder(spark, "runs")
    tables.write_run_tables(sweep.equity_table(), sweep.fills, sweep.holdings, folder)
    fills = tables.read_run_table(spark, folder, "fills", ["trend", "best"])
    counted = fills.groupBy("run_id", "symbol").agg(F.count(F.lit(1)).alias("fills"), F.sum("shares").alias("shares"))
    return shown(counted, 3)


@query(
    _ledger_sql(
        "SELECT 'equity' AS name, count(*) AS rows, " + rnd("sum(ln(equity))", "total", 4)
        + " FROM curve UNION ALL SELECT 'fills', count(*), " + rnd("sum(price)", "total", 4)
        + " FROM filled UNION ALL SELECT 'weights', count(*), " + rnd("sum(weight)", "total", 4)
        + " FROM held"
    )
)
def run_tables(spark, sf):
    """Result tables of a sweep, written and read back."""
    sweep = _sweep(spark, sf)
    folder = scratch_folder(spark, "runs")
    tables.write_run_tables(sweep.equity_table(), sweep.fills, sweep.holdings, folder)
    parts = []
    for name, value in [("equity", F.log("equity")), ("fills", F.col("price")), ("weights", F.col("weight"))]:
        table = tables.read_run_table(spark, folder, name)
        parts.append(
            table.agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total")).select(
                F.lit(name).alias("name"), "rows", "total"
            )
        )
    return shown(parts[0].union(parts[1]).union(parts[2]), 4)


_LUMP_COSTS = Costs(slippage_bps=3, commission_per_share=0.01, commission_bps=1, min_commission=2)


@query(
    with_tables(
        "SELECT run_id, ts, symbol, side, shares, " + rnd("price") + ", " + rnd("reference_price")
        + ", " + rnd("shares * price", "notional") + ", "
        + rnd("greatest(abs(shares) * 0.01e0 + abs(shares * price) * 1e0 / 10000, 2e0)", "commission")
        + ", " + rnd("abs(shares) * abs(price - reference_price)", "slippage_cost")
        + " FROM (SELECT 'lump' AS run_id, c.ts, w.symbol, 'buy' AS side, "
        "trunc(weight * 100000 / c.p) AS shares, c.p AS reference_price, c.p * 1.0003e0 AS price "
        "FROM (SELECT symbol, seq, weight / 0.9e0 AS weight FROM hold_targets) w JOIN "
        "(SELECT *, coalesce(open, prev_mark) AS p FROM calm_cells) c "
        "ON c.symbol = w.symbol AND c.seq = w.seq + 1) WHERE shares <> 0 AND shares * reference_price >= 1",
        recursive=True,
        **_SIGNAL_TABLES,
    )
)
def lump_sum_fills(spark, sf):
    months = fx.calm(fx.brand_months(spark, sf))
    line = scans.timeline(months)
    length = line.agg(F.max("seq") + 1).scalar()
    runs = [Run("lump", "buy_and_hold", {}, _LUMP_COSTS)]
    weights = signals.buy_and_hold(bars.with_seq(months, line), runs, length).weights
    grid = bars.effective_open(bars.dense_grid(months, fields=("open",), line=line))
    fills = portfolio.lump_sum_buy(
        weights, grid, signals.account_frame(spark, runs), line, whole_shares=True
    )
    return shown(fills.drop("seq"), plain=("shares",))


# -- accounts kept from other fills --------------------------------------------------

_FLOW_TABLES = {
    "own_fills": """
      SELECT symbol, ts, seq, sum(CASE WHEN l_returnflag = 'R' THEN -size ELSE size END) AS shares
      FROM trades JOIN day_line USING (ts) GROUP BY ALL HAVING shares <> 0""",
    "own_priced": """
      SELECT f.*, c.close AS reference_price,
        c.close * (1 + CASE WHEN shares > 0 THEN 1 ELSE -1 END / 10000e0) AS price
      FROM own_fills f JOIN day_panel c USING (symbol, seq)""",
    "own_booked": """
      SELECT *, greatest(abs(shares) * 0.005e0 + 0, 1e0) AS commission FROM own_priced""",
    "own_positions": """
      SELECT c.symbol, c.seq, c.ts, coalesce(c.mark, 0) AS mark,
        sum(coalesce(f.shares, 0)) OVER (PARTITION BY c.symbol ORDER BY c.seq) AS position
      FROM day_cells c LEFT JOIN own_booked f ON f.symbol = c.symbol AND f.seq = c.seq""",
    "own_cash": """
      SELECT l.seq, 1e9 - sum(coalesce(flow, 0)) OVER (ORDER BY l.seq) AS cash
      FROM day_line l LEFT JOIN (SELECT seq, sum(CAST(round(shares * price + commission, 9) AS DECIMAL(28, 9))) AS flow
        FROM own_booked GROUP BY seq) USING (seq)""",
}


def _journal_fills(spark, sf):
    """Traded lines per brand and day as one fill at the close, with costs."""
    days = fx.brand_days(spark, sf)
    line = scans.timeline(days)
    accounts = signals.account_frame(
        spark,
        [Run("own", "none", {}, Costs(1.0, 0.005, 0.0, 1.0), 1e9)],
    )
    signed = F.when(F.col("l_returnflag") == "R", -F.col("size")).otherwise(F.col("size"))
    orders = (
        fx.trades(spark, sf)
        .groupBy("symbol", "ts")
        .agg(F.sum(signed).alias("shares"))
        .filter(F.col("shares") != 0)
        .join(days.select("symbol", "ts", F.col("close").alias("reference_price")), ["symbol", "ts"])
        .join(line, "ts")
        .withColumn("run_id", F.lit("own"))
        .join(accounts, "run_id")
    )
    return portfolio.priced_fills(orders), days, line, accounts


@query(
    with_tables(
        "SELECT 'own' AS run_id, symbol, seq, " + rnd("shares", "traded") + ", "
        + rnd("sum(shares) OVER (PARTITION BY symbol ORDER BY seq)", "position") + " FROM own_fills",
        **_FLOW_TABLES,
    )
)
def running_positions(spark, sf):
    fills, *_ = _journal_fills(spark, sf)
    return shown(portfolio.running_position(fills, chunk_rows=250))


@query(
    with_tables(
        "SELECT 'own' AS run_id, seq, " + money("-flow", "flow") + ", "
        + money("1e9 - sum(flow) OVER (ORDER BY seq)", "cash")
        + " FROM (SELECT seq, sum(CAST(round(shares * price + commission, 9) AS DECIMAL(28, 9))) AS flow FROM own_booked GROUP BY seq)",
        **_FLOW_TABLES,
    )
)
def running_cash(spark, sf):
    fills, _, _, accounts = _journal_fills(spark, sf)
    return cents(portfolio.running_cash(fills, accounts, chunk_rows=250, digits=9), "flow", "cash")


@query(
    with_tables(
        "SELECT 'own' AS run_id, p.ts, " + money("any_value(c.cash)", "cash") + ", "
        + money("any_value(c.cash) + sum(CAST(round(p.position * p.mark, 9) AS DECIMAL(28, 9)))", "equity")
        + " FROM own_positions p JOIN own_cash c USING (seq) GROUP BY p.ts",
        **_FLOW_TABLES,
    )
)
def ledger_of_journal_fills(spark, sf):
    fills, days, line, accounts = _journal_fills(spark, sf)
    length = line.agg(F.max("seq") + 1).scalar()
    grid = bars.dense_grid(days, fields=(), line=line)
    out = portfolio.ledger_from_fills(
        fills, grid, accounts, line, length, chunk_rows=1000, digits=9
    )
    return shown(cents(out.select("run_id", "ts", "cash", "equity"), "cash", "equity"), plain=("cash", "equity"))


@query(
    with_tables(
        "SELECT 'own' AS run_id, ts, " + rnd("coalesce(traded / 1e9, 0)", "turnover") + " FROM day_line "
        "LEFT JOIN (SELECT ts, sum(abs(shares) * price) AS traded FROM own_booked GROUP BY ts) USING (ts)",
        **_FLOW_TABLES,
    )
)
def turnover_of_journal_fills(spark, sf):
    """Turnover against a fixed equity of a billion."""
    fills, _, line, _ = _journal_fills(spark, sf)
    flat = line.select(F.lit("own").alias("run_id"), "ts", F.lit(1e9).alias("equity"))
    return shown(metrics.turnover(fills, flat).drop("equity"))
