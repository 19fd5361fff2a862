"""Consecutive numbers and running totals over a whole relation.

A window without partitioning would pull all rows into one task. Here rows are sorted
into ranges, written once so that the ranges stay put, and each range adds the total of
the ranges before it. Only one row per range is ever handled in one place.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import durable

_RANGE, _ROW = "__range", "__row"
# monotonically_increasing_id keeps the row number inside a partition in its low 33 bits.
_ROW_BITS = 33


def _laid_out(df: DataFrame, order_by) -> DataFrame:
    if order_by:
        df = df.orderBy(*order_by)
    laid = df.withColumn(_ROW, F.monotonically_increasing_id())
    return durable(laid.withColumn(_RANGE, F.shiftright(F.col(_ROW), _ROW_BITS)))


def _before(totals: DataFrame, names) -> DataFrame:
    """Totals of all earlier ranges; ``totals`` has one row per range."""
    earlier = W.orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        _RANGE,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__before_{n}") for n in names],
    )


def dense_numbers(df: DataFrame, *order_by, name: str) -> DataFrame:
    """Number rows 1..n in the given order, or in scan order when none is given."""
    laid = _laid_out(df, order_by)
    sizes = laid.groupBy(_RANGE).agg(F.count("*").alias("n"))
    within = F.col(_ROW) - F.shiftleft(F.col(_RANGE), _ROW_BITS) + 1
    # One row per written range: at most a few bytes for each input partition.
    numbered = laid.join(F.broadcast(_before(sizes, ["n"])), _RANGE)
    return numbered.withColumn(name, F.col("__before_n") + within).drop(
        _RANGE, _ROW, "__before_n"
    )


def running_totals(df: DataFrame, order_by: list, values: Mapping[str, Column]) -> DataFrame:
    """Add, for every value, the sum over all rows that come strictly earlier."""
    laid = _laid_out(df.withColumns({f"__v_{n}": v for n, v in values.items()}), order_by)
    totals = laid.groupBy(_RANGE).agg(*[F.sum(f"__v_{n}").alias(n) for n in values])
    offsets = F.broadcast(_before(totals, list(values)))
    earlier = W.partitionBy(_RANGE).orderBy(_ROW).rowsBetween(W.unboundedPreceding, -1)
    within = {
        n: F.coalesce(F.sum(f"__v_{n}").over(earlier), F.lit(0)) for n in values
    }
    summed = laid.withColumns(within).join(offsets, _RANGE)
    summed = summed.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in values})
    return summed.drop(
        _RANGE, _ROW, *[f"__v_{n}" for n in values], *[f"__before_{n}" for n in values]
    )
