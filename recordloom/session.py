"""Session helpers: defaults for own runs, and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows that a partition is worth having for, and rows that are too many for one.
LITTLE_WORK, MUCH_WORK = 20_000, 20_000_000


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Local session for tests and the benchmark. A cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("recordloom")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir`` of the session.

    A machine-local folder is used only when the whole session is local.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="recordloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Used where a result is read several times, or where it depends on how rows were
    laid out in partitions and must not be computed again after an executor is lost.
    Parquet keeps column pruning, pushed filters and sizes for the planner.
    ``remove_stored`` deletes the files when the results are no longer needed.
    """
    spark = df.sparkSession
    path = f"{stored_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/recordloom-{spark.sparkContext.applicationId}"


def remove_stored(spark: SparkSession) -> None:
    """Delete what ``stored`` wrote in this application."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(stored_folder(spark))
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def durable(df: DataFrame) -> DataFrame:
    """``df``, written once and read from the written rows."""
    return stored(df)


def shuffle_width(df: DataFrame, work: int | None = None) -> int:
    """Partitions for a shuffle set by hand: the session's number, fewer for little work, and
    more where a partition would otherwise have too much.

    ``work`` counts what the shuffled rows will be turned into, such as pairs.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if work is None:
        return width
    least = max(df.sparkSession.sparkContext.defaultParallelism, work // LITTLE_WORK)
    return max(min(width, least), work // MUCH_WORK)
