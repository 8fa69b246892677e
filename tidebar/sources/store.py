"""The bar table: partitioned parquet with its coverage."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.markettime import market_date, utc_clock
from tidebar.functions.timeframe import TimeFrame
from tidebar.operators import coverage as cov
from tidebar.schemas import BAR_FIELDS, BARS, COVERAGE
from tidebar.session import durable


class BarStore:
    """Bars by asset class, timeframe, variant (feed and adjustment), period and symbol.

    Periods are months of intraday bars and years of longer ones. Symbols of a period
    share ``buckets`` files, sorted by symbol, so a universe of thousands of symbols
    does not end in millions of tiny files: a symbol selects its bucket by partition
    and its rows by the statistics of the file. The table keeps all hours; sessions
    are filtered on reading.

    A snapshot is a manifest (rows and dates of each symbol in each partition, and the
    load that wrote it) and the coverage. A load writes the partitions it has bars for to
    a folder of its own, then both tables, and commits them with one marker file. If it fails before
    that, the snapshot before it stays readable as it was, and loading again gives the same table.
    Readers plan by the manifest: partitions without wanted symbols or dates are not listed.
    The last ``keep`` snapshots stay; a folder goes when only older ones use it. Folders of failed
    loads stay. One writer at a time: of two that commit the same version, the second fails.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        asset_class: str = "stocks",
        feed: str = "sip",
        adjustment: str = "all",
        buckets: int = 16,
        keep: int = 2,
    ) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.asset_class = asset_class
        self.variant = "crypto" if asset_class == "crypto" else f"{feed}_{adjustment}"
        self.buckets = buckets
        self.keep = keep

    def _place(self, name: str, timeframe: str | TimeFrame) -> str:
        tf = TimeFrame.of(timeframe)
        return (
            f"{self.root}/{name}/asset_class={self.asset_class}/timeframe={tf.label}"
            f"/variant={self.variant}"
        )

    def _file(self, path: str):
        """File system and path object of a place."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _versions(self, timeframe: str | TimeFrame) -> list[int]:
        """Committed snapshots that are still there, oldest first."""
        root = self._place("snapshots", timeframe)
        fs, place = self._file(root)
        if not fs.exists(place):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(place)]
        found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
        return sorted(v for v in found if fs.exists(self._file(f"{root}/version={v}/{_MARKER}")[1]))

    def _snapshot(self, timeframe: str | TimeFrame, version: int | None, name: str, schema) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], schema)
        place = f"{self._place('snapshots', timeframe)}/version={version}/{name}"
        return self.spark.read.schema(schema).parquet(place)

    def _current(self, timeframe: str | TimeFrame) -> int | None:
        return max(self._versions(timeframe), default=None)

    def manifest(self, timeframe: str | TimeFrame) -> DataFrame:
        """Rows and first and last market date of each symbol in each partition."""
        return self._snapshot(timeframe, self._current(timeframe), "manifest", _MANIFEST)

    def _period(self, timeframe: str | TimeFrame) -> Column:
        pattern = "yyyy-MM" if TimeFrame.of(timeframe).is_intraday else "yyyy"
        return F.date_format(utc_clock(F.col("ts")), pattern)

    def _bars(self, timeframe: str | TimeFrame, manifest: DataFrame) -> DataFrame:
        """All rows of the partitions that ``manifest`` names."""
        place = self._place("bars", timeframe)
        # As many as there are periods and buckets, however many symbols and bars.
        parts = manifest.select("load", "period", "bucket").distinct().collect()
        schema = "symbol string, ts timestamp, " + ", ".join(f"{f} double" for f in BAR_FIELDS)
        schema += ", load string, period string, bucket int"
        if not parts:
            return self.spark.createDataFrame([], schema)
        paths = [f"{place}/load={p.load}/period={p.period}/bucket={p.bucket}" for p in parts]
        return self.spark.read.schema(schema).option("basePath", place).parquet(*sorted(paths))

    def read(
        self,
        timeframe: str | TimeFrame,
        symbols: Sequence[str] | None = None,
        start: dt.date | str | None = None,
        end: dt.date | str | None = None,
    ) -> DataFrame:
        """Covered bars; symbols and market dates (both included) prune partitions and row groups."""
        version = self._current(timeframe)
        wanted = self._snapshot(timeframe, version, "manifest", _MANIFEST)
        if symbols is not None:
            wanted = wanted.filter(F.col("symbol").isin(list(symbols)))
        if start is not None:
            wanted = wanted.filter(F.col("last") >= F.lit(start).cast("date"))
        if end is not None:
            wanted = wanted.filter(F.col("first") <= F.lit(end).cast("date"))
        stored = self._bars(timeframe, wanted)
        if symbols is not None:
            stored = stored.filter(F.col("symbol").isin(list(symbols)))
        date = market_date(F.col("ts"))
        if start is not None:
            stored = stored.filter(date >= F.lit(start).cast("date"))
        if end is not None:
            stored = stored.filter(date <= F.lit(end).cast("date"))
        ends = self._snapshot(timeframe, version, "coverage", COVERAGE).select("symbol", "cov_end")
        return (
            stored.join(ends, "symbol")
            .filter(date <= F.col("cov_end"))
            .select("symbol", "ts", *BAR_FIELDS)
        )

    def read_coverage(self, timeframe: str | TimeFrame) -> DataFrame:
        return self._snapshot(timeframe, self._current(timeframe), "coverage", COVERAGE)

    def missing(self, timeframe: str | TimeFrame, requests: DataFrame) -> DataFrame:
        """Requests to send to the vendor, batched by window."""
        return cov.batch_by_window(cov.coverage_gaps(requests, self.read_coverage(timeframe)))

    def load(
        self,
        timeframe: str | TimeFrame,
        new_bars: DataFrame,
        windows: DataFrame,
        last_settled=None,
    ) -> None:
        """Merge newly loaded bars and the windows ``symbol, start, end`` they cover.

        Bars after the new coverage, that is unsettled ones, are not kept.
        """
        versions = self._versions(timeframe)
        version = max(versions, default=None)
        before = self._snapshot(timeframe, version, "coverage", COVERAGE)
        listed = self._snapshot(timeframe, version, "manifest", _MANIFEST)
        covered = durable(cov.merge_coverage(before, windows, last_settled))
        new = durable(
            new_bars.select("symbol", "ts", *BAR_FIELDS)
            .join(covered.select("symbol", "cov_end"), "symbol")
            .filter(market_date(F.col("ts")) <= F.col("cov_end"))
            .drop("cov_end")
            .withColumn("period", self._period(timeframe))
            .withColumn("bucket", F.pmod(F.crc32("symbol"), F.lit(self.buckets)).cast("int"))
        )
        touched = new.select("period", "bucket").distinct()
        old = self._bars(timeframe, listed.join(touched, ["period", "bucket"], "left_semi"))
        merged = durable(cov.upsert_bars(old.select(*new.columns), new))
        load = uuid.uuid4().hex
        (
            merged.repartition("period", "bucket")
            .sortWithinPartitions("period", "bucket", "symbol", "ts")
            .write.option("compression", "snappy")
            .partitionBy("period", "bucket")
            .parquet(f"{self._place('bars', timeframe)}/load={load}")
        )
        date = market_date(F.col("ts"))
        written = merged.groupBy("symbol", "period", "bucket").agg(
            F.count(F.lit(1)).alias("rows"), F.min(date).alias("first"), F.max(date).alias("last")
        )
        manifest = durable(
            listed.join(touched, ["period", "bucket"], "left_anti")
            .select(*_MANIFEST_COLUMNS)
            .unionByName(written.withColumn("load", F.lit(load)).select(*_MANIFEST_COLUMNS))
        )
        loaded = windows.select("symbol").distinct()
        self._commit(
            timeframe,
            (version or 0) + 1,
            manifest,
            covered.join(before.select("symbol", "rows", "written_at"), "symbol", "left")
            .join(loaded.withColumn("is_new", F.lit(True)), "symbol", "left")
            .join(self._settled_rows(timeframe, manifest, covered, loaded), "symbol", "left")
            .select(
                "symbol",
                "cov_start",
                "cov_end",
                F.when(F.col("is_new"), F.coalesce("now", F.lit(0)))
                .otherwise(F.col("rows"))
                .cast("long")
                .alias("rows"),
                F.when(F.col("is_new"), F.current_timestamp())
                .otherwise(F.col("written_at"))
                .alias("written_at"),
            ),
        )
        self._expire(timeframe, [*versions, (version or 0) + 1])

    def _settled_rows(
        self, timeframe: str | TimeFrame, manifest: DataFrame, covered: DataFrame, loaded: DataFrame
    ) -> DataFrame:
        """(symbol, now): bars up to the end of the coverage.

        The manifest has the numbers; only partitions in which a symbol's coverage ends before its
        bars do are read.
        """
        of_loaded = (
            manifest.join(loaded, "symbol", "left_semi")
            .join(covered.select("symbol", "cov_end"), "symbol")
            .filter("first <= cov_end")
        )
        whole = of_loaded.filter("last <= cov_end").select("symbol", "rows")
        cut = of_loaded.filter("last > cov_end").select("symbol", "load", "period", "bucket", "cov_end")
        part = (
            self._bars(timeframe, cut)
            .join(cut, ["symbol", "load", "period", "bucket"])
            .filter(market_date(F.col("ts")) <= F.col("cov_end"))
            .select("symbol", F.lit(1).cast("long").alias("rows"))
        )
        return whole.unionByName(part).groupBy("symbol").agg(F.sum("rows").alias("now"))

    def _commit(
        self, timeframe: str | TimeFrame, version: int, manifest: DataFrame, covered: DataFrame
    ) -> None:
        """Both tables, then the marker that makes them the current snapshot."""
        place = f"{self._place('snapshots', timeframe)}/version={version}"
        fs, marker = self._file(f"{place}/{_MARKER}")
        taken = RuntimeError(f"another load has committed {place}")
        if fs.exists(marker):
            raise taken
        # What a failed load left there is overwritten.
        manifest.write.mode("overwrite").parquet(f"{place}/manifest")
        covered.write.mode("overwrite").parquet(f"{place}/coverage")
        if not fs.createNewFile(marker):
            raise taken

    def _expire(self, timeframe: str | TimeFrame, versions: list[int]) -> None:
        """Remove snapshots before the last ``keep``, and loads that only they use."""
        gone = versions[: -self.keep]
        if not gone:
            return
        used = [
            {r.load for r in self._snapshot(timeframe, v, "manifest", _MANIFEST).select("load").distinct().collect()}
            for v in versions
        ]
        kept = set().union(*used[len(gone) :])
        bars, snapshots = self._place("bars", timeframe), self._place("snapshots", timeframe)
        unused = [f"{bars}/load={x}" for x in sorted(set().union(*used[: len(gone)]) - kept)]
        # The marker goes first, so that a half removed snapshot is none.
        for path in [*(f"{snapshots}/version={v}/{_MARKER}" for v in gone),
                     *(f"{snapshots}/version={v}" for v in gone), *unused]:
            fs, place = self._file(path)
            fs.delete(place, True)


_MARKER = "_COMMITTED"
_MANIFEST_COLUMNS = ["symbol", "period", "bucket", "load", "rows", "first", "last"]
_MANIFEST = "symbol string, period string, bucket int, load string, rows long, first date, last date"
