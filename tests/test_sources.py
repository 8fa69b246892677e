import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import UTC, day, make_bars
from tidebar.functions.timeframe import TimeFrame
from tidebar.operators import bars, coverage, journal
from tidebar.operators.journal import Limits
from tidebar.sources import payload, records, tables
from tidebar.sources.store import BarStore
from tidebar.streaming import bars as stream_bars
from tidebar.streaming import journal as stream_journal


def test_timeframes():
    assert TimeFrame.of("15 mins").label == "15Min"
    assert TimeFrame.of(" 1hour ").label == "1Hour"
    assert TimeFrame.of("1Min").periods_per_year == 252 * 390
    assert TimeFrame.of("1Min", "extended").periods_per_year == 252 * 960
    assert TimeFrame.of(TimeFrame.of("1Hour"), "extended").periods_per_year == 252 * 16
    assert (TimeFrame.of("1Week").periods_per_year, TimeFrame.of("3Month").periods_per_year) == (52, 4)
    for bad in ("day", "1Fortnight", "-1Day", "0Day"):
        with pytest.raises(ValueError):
            TimeFrame.of(bad)
    with pytest.raises(ValueError):
        TimeFrame.of("1Day", "lunch")


def minute_bars(spark, clocks, date="2024-01-03"):
    rows = [("A", dt.datetime.fromisoformat(f"{date}T{c}:00").replace(tzinfo=UTC), 1.0) for c in clocks]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double")


def test_sessions_keep_bars_that_overlap(spark):
    # Market time is five hours behind UTC in January.
    minutes = minute_bars(spark, ["09:00", "14:29", "14:30", "20:59", "21:00"])
    assert bars.filter_session(minutes, "1Min").count() == 2
    assert bars.filter_session(minutes, "1Min", "extended").count() == 5
    hours = minute_bars(spark, ["13:00", "14:00", "20:00", "21:00"])
    kept = bars.filter_session(hours, "1Hour").agg(F.min("ts"), F.max("ts"), F.count("ts")).first()
    assert kept[2] == 2
    assert bars.filter_session(hours, "1Day").count() == 4
    assert bars.filter_session(hours, "1Hour", asset_class="crypto").count() == 4
    five = minute_bars(spark, [f"{m // 60:02d}:{m % 60:02d}" for m in range(0, 1440, 5)])
    assert bars.filter_session(five, "5Min").count() == 78


def test_date_bounds_are_inclusive_market_dates(spark):
    frame = make_bars(spark, {"A": [1.0] * 5})
    assert bars.between_dates(frame, "2024-01-03", "2024-01-04").count() == 2
    assert bars.between_dates(frame, "2024-01-05").count() == 2
    with pytest.raises(ValueError):
        bars.between_dates(frame, "2024-01-04", "2024-01-03")


def test_payload_files(spark, tmp_path):
    page = {
        "A": [{"t": "2024-01-02T05:00:00Z", "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10, "n": 3, "vw": 1.2, "zz": 1}],
        "B": [{"t": "2024-01-02T05:00:00Z", "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10}],
    }
    (tmp_path / "p.json").write_text(json.dumps(page, indent=1))
    got = {r.symbol: r for r in payload.read_bar_payload(spark, str(tmp_path / "p.json")).collect()}
    assert got["A"].vwap == 1.2 and got["B"].trade_count is None and got["B"].vwap is None
    (tmp_path / "empty.json").write_text("{}")
    empty = payload.read_bar_payload(spark, str(tmp_path / "empty.json"))
    assert empty.count() == 0 and "trade_count" in empty.columns
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "1.json").write_text(json.dumps({"bars": page, "next_page_token": "x"}))
    (pages / "2.json").write_text(json.dumps({"bars": None, "next_page_token": None}))
    assert payload.stitch_pages(spark, str(pages)).count() == 2


def test_table_formats(spark, tmp_path):
    assert [tables.table_format(p) for p in ("x.pq", "x.csv", "x.csv.gz", "x")] == ["parquet", "csv", "csv", "parquet"]
    assert tables.table_format("x.csv", "parquet") == "parquet"
    with pytest.raises(ValueError):
        tables.table_format("x", "xlsx")
    frame = make_bars(spark, {"A": [1.0, 2.0]})
    path = tables.write_table(frame, str(tmp_path / "b.csv.gz"))
    assert tables.read_table(spark, path, schema=frame.schema).count() == 2


def test_store_corrects_settles_and_can_be_loaded_again(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "store"))
    assert store.read("1Day").count() == 0 and store.read_coverage("1Day").count() == 0
    first = make_bars(spark, {"A": [1.0] * 10, "B/C": [5.0] * 10})
    window = lambda a, b: spark.createDataFrame(
        [(s, dt.date(2024, 1, a), dt.date(2024, 1, b)) for s in ("A", "B/C")],
        "symbol string, start date, end date",
    )
    settled = dt.date(2024, 1, 8)
    for _ in range(2):
        store.load("1Day", first, window(2, 11), settled)
        got = {r.symbol: r for r in store.read_coverage("1Day").collect()}
        assert (got["A"].cov_start, got["A"].cov_end, got["A"].rows) == (dt.date(2024, 1, 2), settled, 7)
        assert store.read("1Day").count() == 14
    more = make_bars(spark, {"A": [2.0] * 10}).filter(F.col("ts") >= F.lit(day(5)))
    store.load("1Day", more, window(7, 11).filter("symbol = 'A'"), dt.date(2024, 1, 20))
    a = store.read("1Day", ["A"]).orderBy("ts").collect()
    assert [r.close for r in a] == [1.0] * 5 + [2.0] * 5
    assert store.read("1Day", ["B/C"]).count() == 7
    asked = window(2, 12).withColumn("kind", F.lit("x"))
    missing = {tuple(r.symbols): (r.gap_start.day, r.gap_end.day) for r in store.missing("1Day", asked).collect()}
    assert missing == {("A",): (12, 12), ("B/C",): (9, 12)}


@pytest.mark.parametrize(
    "wanted,gap",
    [((3, 5), None), ((1, 5), (1, 1)), ((3, 12), (10, 12)), ((1, 12), (1, 12)), ((20, 22), (20, 22)), ((2, 9), None)],
)
def test_gaps(spark, wanted, gap):
    d = lambda n: dt.date(2024, 3, n)
    asked = spark.createDataFrame([("A", d(wanted[0]), d(wanted[1]))], "symbol string, start date, end date")
    have = spark.createDataFrame([("A", d(2), d(9))], "symbol string, cov_start date, cov_end date")
    got = coverage.coverage_gaps(asked, have).collect()
    assert [(r.gap_start.day, r.gap_end.day) for r in got] == ([gap] if gap else [])


def test_a_window_missing_for_many_symbols_is_split(spark):
    rows = [(f"S{i}", dt.date(2024, 1, 1), dt.date(2024, 1, 2)) for i in range(100)]
    gaps = spark.createDataFrame(rows, "symbol string, gap_start date, gap_end date")
    got = coverage.batch_by_window(gaps, batch_size=10).collect()
    assert len(got) > 5
    assert sorted(s for r in got for s in r.symbols) == sorted(r[0] for r in rows)


def test_embargo(spark):
    now = F.lit(dt.datetime(2024, 5, 1, 15, 0, tzinfo=UTC))
    cases = [("2024-04-01", "2024-05-01"), ("2024-04-01", "2024-04-30"), ("2024-05-01T14:50:00Z", "2024-05-01"),
             ("2024-05-01T10:00:00", "2024-05-01T14:00:00")]
    frame = spark.createDataFrame(cases, "s string, e string")
    got = [r[0] for r in frame.select(coverage.cap_recent(F.col("s"), F.col("e"), now)).collect()]
    assert [g is not None for g in got] == [True, False, False, False]


def test_journal_rules(spark, tmp_path):
    empty, _ = records.read_journal(spark, str(tmp_path / "none"))
    assert empty.count() == 0
    lines = spark.createDataFrame(
        [('{"ts": "2024-05-01T10:00:00+00:00", "symbol": "A", "side": "buy", "notional": 5}',), ("",), ("{oops",), ("  ",)],
        "value string",
    )
    good, bad = journal.parse_lines(lines)
    assert good.count() == 1 and [r.line for r in bad.collect()] == ["{oops"]
    orders = spark.createDataFrame(
        [("2024-05-01T12:00:00+00:00", "A", q, p, 1.0) for q, p in [(1.0, 100.0), (0.0, 5.0), (1.0, None), (10.0, 100.0)]],
        "ts string, symbol string, qty double, price double, multiplier double",
    )
    out = journal.check_orders(orders, good, Limits(allow_live=True)).orderBy("qty", "price").collect()
    assert [r.passed for r in out] == [False, False, True, False]
    assert "over by $500.00" in out[3].reasons[0]
    dry = journal.check_orders(orders, good, Limits(max_notional=10, max_daily_orders=1)).filter("qty = 10").first()
    assert len(dry.reasons) == 3


def test_order_stream_counts_over_batches(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts string, order_id string, symbol string, qty double, price double, multiplier double"
    verdicts = {}
    for batch in range(2):
        rows = [
            (f"2024-05-0{1 + i % 2}T1{batch}:{i:02d}:00+00:00", f"{batch}-{i:02d}", "A", 1.0, 900.0 if i % 5 == 0 else 10.0, 1.0)
            for i in range(20)
        ]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        checked = stream_journal.check_order_stream(stream, Limits(500, 11, True), shards=4)
        job = (
            checked.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        job.awaitTermination()
    for r in spark.read.parquet(out).collect():
        verdicts[r.order_id] = r
    assert len(verdicts) == 40
    seen = {}
    for order_id in sorted(verdicts):
        i = int(order_id[2:])
        clear, d = i % 5 != 0, i % 2
        wanted = clear and seen.get(d, 0) < 11
        seen[d] = seen.get(d, 0) + clear
        assert verdicts[order_id].passed == wanted, order_id
        assert bool(verdicts[order_id].reasons) != wanted


def test_order_stream_forgets_days_that_are_over(spark, tmp_path):
    """No state row is left of a closed day; orders without a time are turned away."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts string, order_id string, symbol string, qty double, price double, multiplier double"
    kept = []
    for name, days in [("a", (1, 2)), ("b", (9,))]:
        rows = [(f"2024-05-{d:02d}T10:00:00+00:00", f"{name}{d}-{i}", "A", 1.0, 10.0, 1.0) for d in days for i in range(5)]
        rows.append(("some day", f"{name}-undated", "A", 1.0, 10.0, 1.0))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        checked = stream_journal.check_order_stream(
            spark.readStream.schema(schema).json(source), Limits(500, 3, True), shards=2, lateness="1 hour"
        )
        job = (
            checked.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        job.awaitTermination()
        kept.append([op["numRowsTotal"] for op in job.lastProgress["stateOperators"]])
    found = {r.order_id: r for r in spark.read.parquet(out).collect()}
    assert len(found) == 17
    assert sum(r.passed for r in found.values()) == 9
    assert not found["a-undated"].passed and "time" in found["a-undated"].reasons[0]
    # Of the second day some state is left at first, of the last one at the end; none of the days before.
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "seen")
    days = {r.key.day for r in state.load(str(tmp_path / "state")).collect()}
    assert days == {dt.date(2024, 5, 9)}, (days, kept)


def test_orders_that_lack_something_never_pass(spark):
    schema = "ts string, order_id string, symbol string, qty double, price double, multiplier double"
    given = [(None, 10.0, 1.0), (1.0, None, 1.0), (float("nan"), 10.0, 1.0), (1.0, float("nan"), 1.0),
             (0.0, 1.0, 1.0), (1e6, 10.0, None), (2.0, 10.0, None)]
    rows = [("2024-01-02T10:00:00+00:00", str(i), "A", *g) for i, g in enumerate(given)]
    orders = spark.createDataFrame(rows, schema)
    limits = Limits(allow_live=True)
    empty = spark.createDataFrame([], "ts string")
    passed = {r.order_id: r.passed for r in journal.check_orders(orders, empty, limits).collect()}
    assert passed == {str(i): i == 6 for i in range(7)}
    dry = journal.check_orders(orders, empty, Limits()).filter("passed").count()
    assert dry == 0


def test_journal_lines_are_one_object_each(spark):
    entry = '{"ts": "2024-01-02", "symbol": "A", "qty": "2", "price": 3}'
    lines = [entry, entry + " xyz", entry + entry, entry + "," + entry, "[" + entry + "]", "{}", '{"qty": "x"}', "5"]
    good, bad = journal.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r.symbol or "", r.qty) for r in good.collect()) == [("", None), ("A", 2.0)]
    assert bad.count() == 6


def _parsings(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")


def test_malformed_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([('{"qty": "x"}',), ("xyz",), ('{"qty": 1}',)], "value string")
    bad = journal.parse_lines(lines.filter("value <> ''"))[1]
    assert bad.count() == 2
    assert _parsings(bad) == _parsings(bad.agg(F.count(F.lit(1)))) == 1


def test_lines_are_trimmed_at_both_ends(spark):
    entry, wide = '{"symbol": "A"}', " " * 50_000
    lines = [f" \t{entry}\x0b ", f"{entry}\r\n", f"\f{entry}", entry, "x y", f" x{wide}y ", f"x{wide}y", "z \u2028",
             " \t\r\n", "", None]
    good, bad = journal.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.symbol for r in good.collect()] == ["A"] * 4
    assert sorted(r.line for r in bad.collect()) == sorted(["x y", f"x{wide}y", f"x{wide}y", "z\u2028"])


def test_streamed_lines_are_parsed_once_and_reasons_stay_lists(spark, tmp_path):
    lines = spark.createDataFrame([('{"qty": "x"}',), ('{"qty": 1}',)], "value string")
    assert _parsings(stream_journal.journal_stream(lines)) == 1
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    entry = {"symbol": "A", "multiplier": 1.0}
    orders = [
        {"ts": f"2024-05-01T10:0{i}:00+00:00", "order_id": str(i), "qty": qty, "price": price} | entry
        for i, (qty, price) in enumerate([(1.0, 1.0), (1.0, 900.0), (-1.0, 1.0)])
    ]
    orders.append({"ts": "some day", "order_id": "3", "qty": 1.0, "price": 900.0} | entry)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(map(json.dumps, orders)))
    stream = stream_journal.journal_stream(spark.readStream.text(str(tmp_path / "in")))
    for name, limits in [("dry", Limits(500, 5, False)), ("live", Limits(500, 0, True))]:
        job = (
            stream_journal.check_order_stream(stream, limits, shards=2).writeStream.format("parquet")
            .option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state"))
            .trigger(availableNow=True).start()
        )
        job.awaitTermination()
        found = {r.order_id: r.reasons for r in spark.read.parquet(str(tmp_path / name)).collect()}
        live = name == "live"
        assert found["0"] == (["already placed 0 order(s) today; limit 0"] if live else ["live orders are off: dry run"])
        assert [r[:8] for r in found["1"]] == ["live ord", "notional"][live:]
        assert found["2"] == ["quantity must be positive"]
        assert [r[:8] for r in found["3"]] == ["live ord", "notional", "the time"][live:]


def test_journal_rows_are_parsed_once(spark):
    lines = spark.createDataFrame([('{"symbol": "A", "qty": "2"}',), ("xyz",), ('{"qty": 1}',)], "value string")
    good = journal.parse_lines(lines.filter("value <> ''"))[0]
    assert sorted(r.qty for r in good.collect()) == [1.0, 2.0]
    assert _parsings(good) == _parsings(good.filter("qty > 1 and symbol = 'A'")) == 1


def test_an_appended_journal_is_parsed_once(spark, tmp_path):
    schema = "symbol string, side string, qty double, price double, order_id string, account_last4 string"
    for i in range(2):
        orders = spark.createDataFrame([("a", "buy", 1.0 + i, 2.0, str(i), "0001")], schema)
        records.append_journal(orders, str(tmp_path / "journal"))
    rows, bad = records.read_journal(spark, str(tmp_path / "journal"))
    assert sorted((r.symbol, r.notional) for r in rows.collect()) == [("A", 2.0), ("A", 4.0)]
    assert bad.count() == 0
    assert _parsings(rows) == _parsings(rows.filter("notional > 2")) == 1


def test_json_records_of_either_shape(spark, tmp_path):
    days = [{"date": f"2024-01-0{i}", "open": "09:30", "close": "16:00"} for i in range(2, 6)]
    shapes = {"lines": "\n".join(map(json.dumps, days)), "array": json.dumps(days), "pretty": json.dumps(days, indent=1)}
    for name, text in shapes.items():
        (tmp_path / name).write_text(text)
        assert records.read_calendar(spark, str(tmp_path / name)).count() == 4
    (tmp_path / "broken").write_text("not json")
    with pytest.raises(ValueError):
        records.read_calendar(spark, str(tmp_path / "broken"))


def test_coverage_of_several_windows(spark):
    d = lambda i: dt.date(2024, 1, i)
    old = spark.createDataFrame([("A", d(5), d(8)), ("B", d(5), d(8))], "symbol string, cov_start date, cov_end date")
    new = [("A", d(2), d(5)), ("A", d(9), d(11)), ("B", d(20), d(21)), ("C", d(2), d(3)), ("C", d(6), d(9))]
    loaded = spark.createDataFrame(new, "symbol string, start date, end date")
    got = {r.symbol: (r.cov_start, r.cov_end) for r in coverage.merge_coverage(old, loaded, d(25)).collect()}
    assert got == {"A": (d(2), d(11)), "B": (d(20), d(21)), "C": (d(6), d(9))}


def test_batches_of_a_stream_keep_every_bar(spark, tmp_path):
    frame = make_bars(spark, {"A": [10.0 + i for i in range(12)]})
    store = BarStore(spark, str(tmp_path / "store"))
    write = stream_bars.upsert_into(store, "1Day")
    at = lambda i: F.lit(day(i))
    for number, part in enumerate([(0, 3), (6, 9), (1, 2), (10, 11)]):  # a gap, a late correction
        write(frame.filter(F.col("ts").between(at(part[0]), at(part[1]))), number)
    assert store.read("1Day").count() == 4 + 4 + 2
    assert store.read_coverage("1Day").count() == 1


def test_a_load_that_fails_leaves_the_snapshot_before(spark, tmp_path, monkeypatch):
    store = BarStore(spark, str(tmp_path / "store"))
    window = spark.createDataFrame([("A", dt.date(2024, 1, 2), dt.date(2024, 1, 6))], "symbol string, start date, end date")
    settled = dt.date(2024, 2, 1)
    store.load("1Day", make_bars(spark, {"A": [1.0] * 5}), window, settled)
    for step in ("_settled_rows", "_commit"):  # bars are written by then, the snapshot isn't
        with monkeypatch.context() as m:
            m.setattr(BarStore, step, lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                store.load("1Day", make_bars(spark, {"A": [2.0] * 5}), window, settled)
        assert {r.close for r in store.read("1Day").collect()} == {1.0}
    store.load("1Day", make_bars(spark, {"A": [2.0] * 5}), window, settled)
    assert [r.close for r in store.read("1Day").collect()] == [2.0] * 5
    with pytest.raises(RuntimeError):
        store._commit("1Day", 2, store.manifest("1Day"), store.read_coverage("1Day"))


def test_dates_prune_partitions_and_old_snapshots_expire(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "store"))
    frame = spark.createDataFrame(
        [("A", dt.datetime(y, 3, 4, 15), *[float(y)] * 7) for y in range(2018, 2024)] ,
        make_bars(spark, {"A": [1.0]}).schema)
    settled = dt.date(2024, 2, 1)
    for y in range(2018, 2024):
        window = spark.createDataFrame([("A", dt.date(y, 1, 1), dt.date(y, 12, 31))], "symbol string, start date, end date")
        store.load("1Day", frame.filter(F.year("ts") == y), window, settled)
    assert len(store._versions("1Day")) == 2 and store.read("1Day").count() == 6
    assert [(r.period, r.rows) for r in store.manifest("1Day").orderBy("period").collect()] == [
        (str(y), 1) for y in range(2018, 2024)]
    assert [r.rows for r in store.read_coverage("1Day").collect()] == [6]
    some = store.read("1Day", ["A"], dt.date(2020, 1, 1), "2021-06-30")
    assert sorted(r.ts.year for r in some.collect()) == [2020, 2021]
    assert len(some.inputFiles()) <= 2 + 2 * 4  # two partitions, and the small coverage table
    assert {f.split("period=")[1][:4] for f in some.inputFiles() if "period=" in f} == {"2020", "2021"}
    assert store.read("1Day", ["B"]).count() == 0 and store.read("1Day", None, "2030-01-01").count() == 0
    # Correcting a year again and again leaves two generations of it.
    window = spark.createDataFrame([("A", dt.date(2023, 1, 1), dt.date(2023, 12, 31))], "symbol string, start date, end date")
    for _ in range(3):
        store.load("1Day", frame.filter(F.year("ts") == 2023), window, settled)
    folders = [p for p in (tmp_path / "store" / "bars").rglob("period=2023")]
    assert len(folders) == 2


def test_malformed_lines_are_placed_over_splits(spark, tmp_path):
    """Files cut into many splits, blank and quoted lines, a file without a last line end."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = []
    for name, count in [("a.jsonl", 500), ("b.jsonl", 3), ("c.jsonl", 0)]:
        out = []
        for i in range(1, count + 1):
            good = '{"ts": "2024-01-02T00:00:00+00:00", "qty": "%d"}' % i
            out.append("" if i % 5 == 0 else "oops %d" % i if i % 3 == 0 else good)
            if out[-1].startswith("oops"):
                want.append((name, i, out[-1]))
        (tmp_path / name).write_text("\n".join(out))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = records.malformed_lines(spark, str(tmp_path))
        got = [(r.file.rsplit("/", 1)[1], r.line_number, r.line) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == sorted(want)
    assert records.malformed_lines(spark, str(tmp_path / "none")).count() == 0


def test_run_tables_are_few_files_whatever_the_runs(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.format_string("run-%04d", F.col("id") % 1000).alias("run_id"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
        F.col("id").cast("double").alias("equity"),
    )
    tables.write_run_tables(rows, rows.drop("equity"), rows, str(tmp_path / "runs"))
    for name in tables.RUN_TABLES:
        assert 0 < len(list((tmp_path / "runs" / name).glob("*.parquet"))) <= 32
    found = tables.read_run_table(spark, str(tmp_path / "runs"), "equity", ["run-0007", "run-0500"])
    assert "In(run_id, [run-0007,run-0500])" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 40
    with pytest.raises(ValueError, match="table must be"):
        tables.read_run_table(spark, str(tmp_path / "runs"), "orders")


@pytest.mark.parametrize("kinds", ["n long", "n int, m int", "n long, m string"])
def test_ties_of_ticks_are_ordered_with_nulls_first(spark, kinds):
    big, text = 2**63 - 1 if "long" in kinds else 2**31 - 1, "string" in kinds
    numbers = [None, -big - 1, -1, 0, 7, big]
    more = "m" in kinds.split(", ")[-1]
    second = [None, "a", "b"] if text else [None, -5, 5]
    keys = [(n, m) for n in numbers for m in second] if more else [(n,) for n in numbers]
    start = dt.datetime(2024, 1, 2, 15, tzinfo=UTC)
    rows = [("A", start + dt.timedelta(microseconds=i // len(keys)), float(i + 1), 1, *keys[i % len(keys)])
            for i in range(2 * len(keys))]
    late = [("B", start, float(len(keys) - i), 1, *k) for i, k in enumerate(keys)]
    ticks = spark.createDataFrame(rows + late, f"symbol string, ts timestamp, price double, size long, {kinds}")
    made = bars.ticks_to_bars(ticks.orderBy(F.rand(3)), "1Hour", ["n", "m"] if more else ["n"])
    found = {r.symbol: (r.open, r.close) for r in made.collect()}
    assert found == {"A": (1.0, 2.0 * len(keys)), "B": (float(len(keys)), 1.0)}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert ("SortAggregate" in plan) == text
