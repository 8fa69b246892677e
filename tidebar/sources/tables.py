"""Parquet and CSV tables."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidebar.functions.timeframe import TimeFrame
from tidebar.operators import bars as bar_ops
from tidebar.sources.store import BarStore

# Formats and the path endings that select them.
FORMATS = ("parquet", "csv")
SUFFIX_FORMATS = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".gz": "csv"}


def table_format(path: str, fmt: str | None = None) -> str:
    """The given format, else the one of the path's ending, else parquet."""
    chosen = fmt or SUFFIX_FORMATS.get(PurePath(path).suffix.lower(), "parquet")
    if chosen not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, got {chosen!r}")
    return chosen


def write_table(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    mode: str = "overwrite",
    partition_by: tuple[str, ...] = (),
) -> str:
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if table_format(path, fmt) == "parquet":
        writer.option("compression", "snappy").parquet(path)
    else:
        packed = "gzip" if path.lower().endswith(".gz") else "none"
        writer.option("header", True).option("compression", packed).csv(path)
    return path


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None
) -> DataFrame:
    """Read a written table. CSV keeps its types only if the schema is given."""
    if table_format(path, fmt) == "parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def export_bars(
    store: BarStore,
    path: str,
    symbols: list[str],
    start: str,
    end: str | None,
    timeframe: str | TimeFrame = "1Day",
    session: str = "regular",
    fmt: str | None = None,
) -> str:
    """Write the stored bars of some symbols and dates, in time and symbol order."""
    wanted = bar_ops.between_dates(store.read(timeframe, symbols, start, end), start, end)
    kept = bar_ops.filter_session(wanted, timeframe, session, store.asset_class)
    columns = [c for c in ["ts", "symbol", *kept.columns] if c in kept.columns]
    ordered = kept.select(*dict.fromkeys(columns)).orderBy("ts", "symbol")
    return write_table(ordered, path, fmt)


RUN_TABLES = ("equity", "fills", "weights")


def write_run_tables(
    equity: DataFrame, fills: DataFrame, holdings: DataFrame, path: str, mode: str = "overwrite"
) -> None:
    """Equity, fills and weights of all runs, a folder per table.

    Files hold ranges of runs and times, so their number follows the amount of data and not the number of
    runs, a long run is spread over several, and readers skip files and row groups by their statistics.
    """
    for name, frame in zip(RUN_TABLES, (equity, fills, holdings)):
        out = frame.repartitionByRange("run_id", "ts").sortWithinPartitions("run_id", "ts")
        write_table(out, f"{path.rstrip('/')}/{name}", "parquet", mode)


def read_run_table(
    spark: SparkSession, path: str, name: str, run_ids: Iterable[str] | None = None
) -> DataFrame:
    """One table of :func:`write_run_tables`, of all runs or of some."""
    if name not in RUN_TABLES:
        raise ValueError(f"table must be one of {', '.join(RUN_TABLES)}, got {name!r}")
    rows = read_table(spark, f"{path.rstrip('/')}/{name}", "parquet")
    return rows if run_ids is None else rows.filter(F.col("run_id").isin(*run_ids))
