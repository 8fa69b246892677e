"""Building blocks of the comparison SQL (DuckDB dialect)."""

from __future__ import annotations

import re

from tidebar.plans.registry import NUDGE


def et(ts: str) -> str:
    return f"({ts} AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"


def rnd(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(({expr}) + {NUDGE}, {digits}) + 0e0 AS {name or expr.split('.')[-1]}"


def money(expr: str, name: str) -> str:
    """SQL of :func:`tidebar.plans.registry.cents`."""
    return f"round(CAST({expr} AS DECIMAL(38, 6)), 2)::DOUBLE AS {name}"


def _bars(source: str, bucket: str, order: str) -> str:
    return f"""
    SELECT symbol, bucket AS ts, first(price ORDER BY {order}) AS open, max(price) AS high,
      min(price) AS low, last(price ORDER BY {order}) AS close,
      sum(size)::DOUBLE AS volume, count(*)::DOUBLE AS trade_count,
      sum(price * size) / sum(size) AS vwap
    FROM (SELECT *, {bucket} AS bucket FROM {source}) GROUP BY symbol, bucket"""


_ET_DAY = f"(CAST({et('ts')} AS DATE)::TIMESTAMP AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC')"
_TRADE_ORDER = "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, size"


def _line(bars: str) -> str:
    return (
        f"SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS seq "
        f"FROM (SELECT DISTINCT ts FROM {bars})"
    )


def _panel(bars: str, line: str) -> str:
    return f"SELECT b.*, l.seq FROM {bars} b JOIN {line} l USING (ts)"


def _cells(bars: str, line: str) -> str:
    return f"""
    SELECT *, lag(mark) OVER (PARTITION BY symbol ORDER BY seq) AS prev_mark FROM (
      SELECT g.symbol, g.ts, g.seq, b.open, b.close, b.high,
        last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.seq) AS mark
      FROM (SELECT s.symbol, l.ts, l.seq FROM (SELECT DISTINCT symbol FROM {bars}) s, {line} l) g
      LEFT JOIN {bars} b ON b.symbol = g.symbol AND b.ts = g.ts)"""


_CALM = (
    "SELECT symbol, ts, 100 * pow(open, 0.02e0) AS open, 100 * pow(high, 0.02e0) AS high, "
    "100 * pow(low, 0.02e0) AS low, 100 * pow(close, 0.02e0) AS close FROM {}"
)

TABLES = {
    "ticks": (
        "SELECT event_type AS symbol, ts, value AS price, 1 + user_id % 10 AS size, event_id "
        "FROM events WHERE value > 0"
    ),
    "hourly": _bars("ticks", "date_trunc('hour', ts)", "ts, event_id"),
    "daily": _bars("ticks", _ET_DAY, "ts, event_id"),
    "trades": (
        "SELECT p_brand AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, "
        "l_quantity AS size, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, "
        "l_returnflag, p_type FROM lineitem JOIN part ON l_partkey = p_partkey"
    ),
    "days": _bars("trades", "date_trunc('day', ts)", _TRADE_ORDER),
    "months": _bars("trades", "date_trunc('month', ts)", _TRADE_ORDER),
    "calm_days": _CALM.format("days"),
    "calm_months": _CALM.format("months"),
    "calm_day_line": _line("calm_days"),
    "calm_day_panel": _panel("calm_days", "calm_day_line"),
    "calm_day_cells": _cells("calm_days", "calm_day_line"),
    "calm_month_line": _line("calm_months"),
    "calm_panel": _panel("calm_months", "calm_month_line"),
    "calm_cells": _cells("calm_months", "calm_month_line"),
    "hour_line": _line("hourly"),
    "day_line": _line("days"),
    "month_line": _line("months"),
    "hour_panel": _panel("hourly", "hour_line"),
    "day_panel": _panel("days", "day_line"),
    "month_panel": _panel("months", "month_line"),
    "hour_cells": _cells("hourly", "hour_line"),
    "day_cells": _cells("days", "day_line"),
    "month_cells": _cells("months", "month_line"),
    "bench": "SELECT o_orderdate AS ts, avg(o_totalprice) AS close FROM orders GROUP BY 1",
    "journal": """
      SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS ts, symbol,
        CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, size AS qty, price,
        CASE WHEN p_type = 'PROMO' THEN 100e0 ELSE 1e0 END AS multiplier,
        round(size * price * CASE WHEN p_type = 'PROMO' THEN 100e0 ELSE 1e0 END, 2) AS notional,
        l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS order_id,
        lpad((l_suppkey % 10000)::VARCHAR, 4, '0') AS account_last4, '' AS note
      FROM trades""",
    "proposed": """
      SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS ts,
        o_orderdate::DATE AS day, o_orderkey::VARCHAR AS order_id, o_orderpriority AS symbol,
        'buy' AS side, 1e0 AS qty, o_totalprice AS price, 1e0 AS multiplier,
        o_totalprice AS notional FROM orders""",
    "assets": """
      SELECT s_name AS symbol, r_name AS exchange, s_acctbal >= 0 AS tradable,
        s_acctbal >= 5000 AS shortable
      FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "day_spans": (
        "SELECT symbol, min(d) AS cov_start, max(d) AS cov_end, count(*) AS n, "
        "date_diff('day', min(d), max(d)) AS days "
        f"FROM (SELECT symbol, CAST({et('ts')} AS DATE) AS d FROM days) GROUP BY symbol"
    ),
    "requests": """
      SELECT symbol, 'all' AS kind, cov_start AS "start", cov_end AS "end" FROM day_spans
      UNION ALL SELECT symbol, 'half', cov_start, cov_start + (days // 2)::INT FROM day_spans
      UNION ALL SELECT symbol, 'later', cov_end + 10, cov_end + 20 FROM day_spans
      UNION ALL SELECT symbol, 'inside', cov_start + 5, cov_start + (days // 2)::INT - 5 FROM day_spans""",
    "covered": (
        "SELECT symbol, cov_start, cov_start + (days // 2)::INT AS cov_end, n AS rows FROM day_spans"
    ),
    "gaps": """
      SELECT symbol, kind,
        CASE WHEN "start" >= c.cov_start AND "start" <= c.cov_end AND "end" > c.cov_end
          THEN c.cov_end + 1 ELSE "start" END AS gap_start,
        CASE WHEN "start" < c.cov_start AND "end" >= c.cov_start AND "end" <= c.cov_end
          THEN c.cov_start - 1 ELSE "end" END AS gap_end
      FROM requests JOIN covered c USING (symbol)
      WHERE NOT ("start" >= c.cov_start AND "end" <= c.cov_end)""",
    "hour_returns": """
      SELECT symbol AS run_id, ts, seq, close / max(close) OVER (PARTITION BY symbol ORDER BY seq
        RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS r FROM hour_panel""",
    "day_returns": """
      SELECT symbol AS run_id, ts, seq, close / max(close) OVER (PARTITION BY symbol ORDER BY seq
        RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS r FROM day_panel""",
}


def with_tables(body: str, recursive: bool = False, **extra: str) -> str:
    """Put the tables that ``body`` mentions, directly or not, in front of it."""
    known = {**TABLES, **extra}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                if re.search(rf"(FROM|JOIN|,)\s*\(?\s*{name}\b", text, re.IGNORECASE):
                    visit_name(name)

    active: set[str] = set()

    def visit_name(name: str) -> None:
        if name in active or name in needed:
            return
        active.add(name)
        visit(known[name])
        active.discard(name)
        needed.append(name)

    visit(body)
    if not needed:
        return body
    # Recursion reads the other tables once per step, so they are worked out first.
    fixed = lambda n: recursive and not re.search(rf"\\bFROM {n}\\b", known[n])
    parts = ", ".join(
        f"{n} AS {'MATERIALIZED ' if fixed(n) else ''}({known[n]})" for n in needed
    )
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts} {body}"
