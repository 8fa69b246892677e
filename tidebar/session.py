"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "tidebar", partitions: int = 8) -> SparkSession:
    """Session for tests and local trials."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table next to the checkpoints and continue from there.

    It survives the loss of executors, readers load only the columns they need, and
    its size is known, so that a small one can be broadcast.
    """
    path = scratch_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables made by ``durable`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for name in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Spark's setting that removes what a statement has shuffled as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing(spark: SparkSession):
    """What statements in here shuffle is removed when they end, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder path where the cluster keeps checkpoints, shared by all executors.

    Where ``spark.checkpoint.dir`` is not set, a local session uses a folder of its own; on a
    cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidebar-scratch-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
