"""Preparing training data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def fill_with_mode(df: DataFrame, key: str, columns=None) -> DataFrame:
    """Replace NULLs by the most frequent value of the row's group, the lowest on ties.

    A column without any value in a group stays NULL. Rows with a NULL key drop out.
    Values are counted before they meet in a group, so a group holding a large share of
    the rows is spread over the cluster up to one row per distinct value.
    """
    columns = [c for c in (columns or df.columns) if c != key]
    df = df.filter(F.col(key).isNotNull())

    def modes(column: str) -> DataFrame:
        counted = df.filter(F.col(column).isNotNull()).groupBy(key, column).agg(
            F.count("*").alias("n")
        )
        order = F.struct((-F.col("n")).alias("n"), F.col(column).alias("value"))
        return counted.groupBy(key).agg(F.min(order)["value"].alias(f"__mode_{column}"))

    # One row per group with all its modes, so that the rows themselves are joined once.
    found = reduce(
        lambda x, y: x.unionByName(y, allowMissingColumns=True), map(modes, columns)
    )
    found = found.groupBy(key).agg(*[F.max(f"__mode_{c}").alias(f"__mode_{c}") for c in columns])
    return df.join(found, key, "left").select(
        *[
            F.coalesce(F.col(c), F.col(f"__mode_{c}")).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def distinct_keys(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    """Number of distinct keys; NULL counts as a value."""
    distinct = F.approx_count_distinct(key) if approximate else F.countDistinct(key)
    has_null = F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0))
    return df.agg((distinct + has_null).alias("distinct_keys"))
