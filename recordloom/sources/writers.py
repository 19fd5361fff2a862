"""Sinks: tables, views, generated ids, added columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.vectors import Embedder
from ..operators.numbering import dense_numbers
from ..schemas import RECORD_VECTORS


def with_dense_id(df: DataFrame, *order_by, id_column: str = "id") -> DataFrame:
    """Number the rows 1..n, by the given order or else in scan order.

    An id the rows already have is kept as ``source_id``.
    """
    existing = [c for c in df.columns if c.lower() == id_column.lower()]
    if existing:
        df = df.withColumnRenamed(existing[0], "source_id")
    return dense_numbers(df, *order_by, name=id_column)


def upload(df: DataFrame, table: str, *order_by, path: str | None = None) -> None:
    """Replace the table by the rows with generated ids."""
    overwrite(with_dense_id(df, *order_by), table, path=path)


def overwrite(
    df: DataFrame, table: str, partition_by: Sequence[str] = (), path: str | None = None
) -> None:
    """Create or replace a table from a query, in the warehouse or at ``path``."""
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def rewrite(spark: SparkSession, table: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Replace a table by ``change`` of its own rows.

    Spark cannot overwrite what it is reading, so the new rows are written beside the table,
    and take its name once they are complete. If the job fails, the table is as it was; if the
    exchange of names is cut short, ``finish_rewrite`` (which runs first) brings it to an end.
    Partition columns are kept. Every version has a folder of its own beside the first, so
    that names change without files being moved.
    """
    finish_rewrite(spark, table)
    rows = spark.table(table)
    partitions = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    path = f"{_told(spark, table)['Location'].split(_VERSION)[0]}{_VERSION}{uuid.uuid4().hex[:8]}"
    overwrite(change(rows), f"{table}{_NEW}", partitions, path)
    spark.sql(f"ALTER TABLE {table} RENAME TO {table}{_OLD}")
    spark.sql(f"ALTER TABLE {table}{_NEW} RENAME TO {table}")
    _drop(spark, f"{table}{_OLD}")


_NEW, _OLD, _VERSION = "__rewritten", "__before", "__v"


def finish_rewrite(spark: SparkSession, table: str) -> None:
    """Bring a rewrite that was cut short to its end, or undo it if its rows were not complete.

    The old rows lose their name only after the new ones are complete.
    """
    exists = spark.catalog.tableExists
    if exists(table):
        _drop(spark, f"{table}{_OLD}")
        _drop(spark, f"{table}{_NEW}")
    elif exists(f"{table}{_OLD}"):
        if exists(f"{table}{_NEW}"):
            spark.sql(f"ALTER TABLE {table}{_NEW} RENAME TO {table}")
            _drop(spark, f"{table}{_OLD}")
        else:
            spark.sql(f"ALTER TABLE {table}{_OLD} RENAME TO {table}")


def _told(spark: SparkSession, table: str) -> dict[str, str]:
    """What the catalog says of a table, ``Type`` and ``Location`` among it."""
    return {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}


def _drop(spark: SparkSession, table: str) -> None:
    """Drop a table and its files, also those at a path."""
    if not spark.catalog.tableExists(table):
        return
    told = _told(spark, table)
    spark.sql(f"DROP TABLE {table}")
    if told["Type"] == "EXTERNAL":
        path = spark._jvm.org.apache.hadoop.fs.Path(told["Location"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def embed_table(
    spark: SparkSession, table: str, embed: Embedder, columns: Mapping[str, str] = RECORD_VECTORS
) -> None:
    """Set the vector column of every text column of a table, in place."""
    rewrite(spark, table, lambda rows: embed_columns(rows, embed, columns))


def append(df: DataFrame, table: str) -> None:
    """Add rows to a table, matching columns by name; makes the table if there is none."""
    df.write.mode("append").format("parquet").saveAsTable(table)


def insert_select(df: DataFrame, table: str) -> None:
    """Add rows to an existing table, matching columns by position."""
    df.write.insertInto(table)


def create_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def create_table(
    spark: SparkSession, table: str, schema: T.StructType, path: str | None = None
) -> None:
    """Empty typed table, replacing any of that name."""
    overwrite(spark.createDataFrame([], schema), table, path=path)


def add_missing_columns(df: DataFrame, columns: Mapping[str, T.DataType]) -> DataFrame:
    """Add the columns that are not there yet, as NULL. Repeating it changes nothing."""
    present = {c.lower() for c in df.columns}
    missing = {
        name: F.lit(None).cast(kind)
        for name, kind in columns.items()
        if name.lower() not in present
    }
    return df.withColumns(missing) if missing else df


def embed_columns(
    df: DataFrame, embed: Embedder, columns: Mapping[str, str] = RECORD_VECTORS
) -> DataFrame:
    """Set the vector column of every text column, for all rows."""
    return embed(df, columns)
