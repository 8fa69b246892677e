"""Calendar, universe and journal files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidebar.operators import journal as journal_ops
from tidebar.operators.coverage import filter_universe
from tidebar.schemas import CALENDAR, DEFAULT_EXCHANGES, JOURNAL, UNIVERSE
from tidebar.session import durable

_BAD = "_unreadable"


def typed_calendar(rows: DataFrame) -> DataFrame:
    return rows.withColumn("date", F.to_date("date"))


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON lines or of one JSON array; what cannot be read is an error."""
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    reader = spark.read.schema(wide).option("columnNameOfCorruptRecord", _BAD)
    bad = []
    for whole in (False, True):
        rows = reader.option("multiLine", whole).json(path)
        bad = rows.filter(F.col(_BAD).isNotNull()).limit(1).collect()
        if not bad:
            return rows.drop(_BAD)
    raise ValueError(f"not JSON records in {path}: {str(bad[0][_BAD])[:80]!r}")


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Trading sessions by date, from a JSON array or JSON lines."""
    rows = read_json(spark, path, CALENDAR)
    return typed_calendar(rows).orderBy("date")


def read_universe(
    spark: SparkSession,
    path: str,
    exchanges: tuple[str, ...] = DEFAULT_EXCHANGES,
    tradable_only: bool = True,
    shortable_only: bool = False,
    fmt: str = "json",
) -> DataFrame:
    """Assets of the chosen exchanges."""
    rows = (
        read_json(spark, path, UNIVERSE)
        if fmt == "json"
        else spark.read.schema(UNIVERSE).format(fmt).load(path)
    )
    return filter_universe(rows, exchanges, tradable_only, shortable_only)


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Journal rows and malformed lines; a journal that does not exist is empty."""
    lines = _text_lines(spark, path)
    if lines is None:
        empty = spark.createDataFrame([], JOURNAL)
        return empty, spark.createDataFrame([], "line string")
    return journal_ops.parse_lines(lines)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Malformed lines of a journal with their ``file`` and ``line_number``, counted from 1.

    Blank lines count. A file is read in splits side by side, so the number of a line is its
    place in its split plus the lines of the splits before. The places of all lines, without
    the text of good ones, are written once: another reading could cut the splits elsewhere.
    """
    lines = _text_lines(spark, path)
    if lines is None:
        return spark.createDataFrame([], "file string, line_number long, line string")
    placed = lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),
    )
    blank = F.regexp_replace("value", r"\s+", "") == ""
    judged = journal_ops.judged_lines(placed.withColumn("value", F.when(blank, "{}").otherwise(F.col("value"))))
    kept = durable(
        judged.select("file", "split", "place", F.when(~F.col("good"), F.col("line")).alias("line"))
    )
    splits = kept.groupBy("file", "split").agg(
        F.count(F.lit(1)).alias("lines"), F.min("place").alias("first")
    )
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "file", "split", (F.coalesce(F.sum("lines").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift")
    )
    return (
        kept.filter(F.col("line").isNotNull())
        .join(starts, ["file", "split"])
        .select("file", (F.col("place") + F.col("shift")).alias("line_number"), "line")
    )


def _text_lines(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.text(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_journal(orders: DataFrame, path: str, now: Column | None = None) -> None:
    """Add placed orders to a journal folder of JSON lines."""
    journal_ops.entries(orders, now).write.mode("append").json(path)
