"""Queries on order journals and order checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidebar.functions import trading
from tidebar.operators import journal
from tidebar.operators.journal import Limits
from tidebar.plans import fixtures as fx
from tidebar.plans.registry import query, shown
from tidebar.plans.sql import money, rnd, with_tables
from tidebar.session import scratch_folder
from tidebar.sources import records

_LIMITS = Limits(max_notional=250_000.0, max_daily_orders=8, allow_live=True)

_JOURNAL = ", ".join(
    ["ts", "symbol", "side", "qty", "price", "multiplier", "notional", "order_id", "account_last4", "note"]
)


def _lines(spark, sf):
    """Journal lines with the documents mixed in as malformed ones, and blanks.

    Every third line has quoted numbers. Objects with something after them and two objects in a line are malformed.
    """
    entry = F.to_json(F.struct("*"))
    quoted = F.regexp_replace(entry, r'"qty":([0-9.eE+-]+)', r'"qty":"$1"')
    third = F.crc32("order_id") % 3 == 0
    good = fx.journal(spark, sf).select(F.when(third, quoted).otherwise(entry).alias("value"))
    first = fx.proposed_orders(spark, sf).select(F.to_json(F.struct("ts", "symbol", "qty")).alias("value"))
    good = good.unionByName(first.select(F.concat("value", F.lit(" xyz")).alias("value")))
    good = good.unionByName(first.select(F.concat("value", "value").alias("value")))
    docs = fx.table(spark, sf, "documents")
    bad = docs.select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value"))
    blank = docs.select(F.lit("   ").alias("value"))
    return good.unionByName(bad).unionByName(blank)


@query(with_tables(f"SELECT {_JOURNAL} FROM journal"))
def journal_lines(spark, sf):
    return journal.parse_lines(_lines(spark, sf))[0]


@query(
    "SELECT (SELECT count(*) FROM documents WHERE trim(text, ' \t\r\n\v\f') <> '') "
    "+ 2 * (SELECT count(*) FROM orders) AS lines"
)
def malformed_journal_lines(spark, sf):
    rejected = journal.parse_lines(_lines(spark, sf))[1]
    return rejected.agg(F.count(F.lit(1)).alias("lines"))


@query(
    with_tables(
        "SELECT month, line_number, order_id FROM (SELECT *, ts[1:7] AS month, sum(CASE WHEN k % 11 = 0 THEN 2 ELSE 1 END) "
        "OVER (PARTITION BY ts[1:7] ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT AS line_number "
        "FROM (SELECT *, order_id::BIGINT AS k FROM proposed)) WHERE k % 7 = 0"
    )
)
def malformed_journal_places(spark, sf):
    """A journal file per month, with malformed lines and with blank ones before others."""
    key = F.col("order_id").cast("long")
    entry = F.to_json(F.struct("ts", "symbol", "qty", "order_id"))
    line = F.when(key % 7 == 0, F.concat(entry, F.lit(" xyz"))).otherwise(entry)
    before = F.when(key % 11 == 0, F.array(F.lit(""), line)).otherwise(F.array(line))
    month = F.substring("ts", 1, 7).alias("month")
    lines = fx.proposed_orders(spark, sf).select(month, key.alias("k"), F.posexplode(before).alias("n", "value"))
    folder = scratch_folder(spark, "journal")
    ordered = lines.repartition("month").sortWithinPartitions("month", "k", "n")
    ordered.select("month", "value").write.partitionBy("month").text(folder)
    return records.malformed_lines(spark, folder).select(
        F.regexp_extract("file", "month=([0-9-]+)", 1).alias("month"),
        "line_number",
        F.get_json_object(F.regexp_replace("line", " xyz$", ""), "$.order_id").alias("order_id"),
    )


@query(
    with_tables(
        "SELECT '2024-05-06T07:08:09+00:00' AS ts, upper(symbol) AS symbol, side, qty, price, multiplier, "
        "notional, order_id, account_last4, note FROM journal"
    )
)
def appended_journal(spark, sf):
    """Orders journaled in two appends and read back."""
    placed = fx.journal(spark, sf).drop("ts", "notional")
    folder = scratch_folder(spark, "journal")
    now = F.lit(dt.datetime(2024, 5, 6, 7, 8, 9, tzinfo=dt.timezone.utc))
    early = F.col("qty") < 20
    records.append_journal(placed.filter(early), folder, now)
    records.append_journal(placed.filter(~early), folder, now)
    return records.read_journal(spark, folder)[0]


@query(with_tables("SELECT ts[1:10]::DATE AS day, count(*) AS orders FROM journal GROUP BY 1"))
def daily_order_counts(spark, sf):
    return journal.daily_order_count(fx.journal(spark, sf))


@query(
    with_tables(
        "SELECT symbol, count(*) AS orders, "
        + money("sum(CASE WHEN side = 'buy' THEN CAST(notional AS DECIMAL(28, 2)) ELSE 0 END)", "bought") + ", "
        + money("sum(CASE WHEN side = 'buy' THEN 0 ELSE CAST(notional AS DECIMAL(28, 2)) END)", "sold") + ", "
        + money("sum(CASE WHEN side = 'buy' THEN 1 ELSE -1 END * CAST(notional AS DECIMAL(28, 2)))", "net")
        + ", min(ts) AS first_ts FROM journal GROUP BY ROLLUP (symbol)"
    )
)
def journal_summary(spark, sf):
    return journal.journal_summary(fx.journal(spark, sf))


@query(with_tables(f"SELECT {_JOURNAL} FROM journal WHERE ts[1:10] = '1998-03-04'"))
def journal_of_a_day(spark, sf):
    return journal.journal_today(fx.journal(spark, sf), dt.date(1998, 3, 4))


@query(
    with_tables(
        "SELECT count(*) AS orders, " + money("coalesce(sum(CAST(notional AS DECIMAL(28, 2))), 0)", "notional")
        + " FROM journal WHERE ts[1:10] = '1998-03-04'"
    )
)
def total_of_a_day(spark, sf):
    return journal.day_total(fx.journal(spark, sf), dt.date(1998, 3, 4))


@query(
    with_tables(
        "SELECT order_id, " + rnd("notional * 100", "notional", 2) + " FROM proposed"
    )
)
def option_notionals(spark, sf):
    orders = fx.proposed_orders(spark, sf)
    amount = trading.order_notional(F.col("qty"), F.col("price"), F.lit(100.0))
    return shown(orders.select("order_id", amount.alias("notional")), 2)


@query(
    with_tables(
        "SELECT order_id, day, count(*) OVER (PARTITION BY day) AS placed_today FROM proposed"
    )
)
def orders_with_daily_count(spark, sf):
    orders = fx.proposed_orders(spark, sf)
    out = journal.orders_with_daily_count(orders, orders)
    return out.select("order_id", "day", "placed_today")


@query(
    with_tables(
        "SELECT order_id, placed_today, CASE "
        "WHEN NOT coalesce(qty > 0, false) THEN 'quantity must be positive' "
        "WHEN NOT coalesce(price > 0, false) THEN 'price must be positive' ELSE concat_ws('; ', "
        "CASE WHEN notional > 250000 THEN 'notional $' || format('{:,.2f}', notional) || "
        "' exceeds $250,000.00 (over by $' || format('{:,.2f}', notional - 250000) || ')' END, "
        "CASE WHEN placed_today >= 8 THEN 'already placed ' || placed_today || ' order(s) today; limit 8' END"
        ") END AS reasons, coalesce(qty > 0 AND price > 0 AND NOT (notional > 250000 OR placed_today >= 8), false) "
        "AS passed FROM (SELECT * REPLACE (qty * price * coalesce(multiplier, 1) AS notional) FROM ("
        "SELECT * REPLACE (CASE o_key % 31 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 1 END AS qty, "
        "CASE o_key % 37 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE price END AS price, "
        "CASE o_key % 5 WHEN 0 THEN NULL ELSE 1 END AS multiplier), count(*) OVER (PARTITION BY day) AS placed_today "
        "FROM (SELECT *, order_id::BIGINT AS o_key FROM proposed)))"
    )
)
def order_verdicts(spark, sf):
    """Orders of which some lack a quantity, a price or a multiplier, or have none to speak of."""
    orders = fx.proposed_orders(spark, sf)
    key = F.col("order_id").cast("long")
    one = F.lit(1.0)
    orders = orders.withColumns(
        {
            "qty": F.when(key % 31 == 1, 0.0).when(key % 31 == 2, -1.0).when(key % 31 != 0, one),
            "price": F.when(key % 37 == 1, 0.0).when(key % 37 != 0, F.col("price")),
            "multiplier": F.when(key % 5 != 0, one),
        }
    )
    out = journal.check_orders(orders, orders, _LIMITS)
    return out.select(
        "order_id", "placed_today", F.array_join("reasons", "; ").alias("reasons"), "passed"
    )
