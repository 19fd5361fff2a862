"""Exact medians of groups of any size.

An aggregate would keep all values of a group in one place. Here the different values of all
groups are counted, and sorted into ranges together. A group that lies inside one range has
its median read off there. Of a group that is cut by the ends of ranges, only sums travel: they
tell in which range, and how far into it, the middle lies, and the value is picked there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import durable, shuffle_width

_METRIC, _VALUE, _N, _RANGE, _BEFORE = "__metric", "__value", "__n", "__range", "__before"


def exact_medians(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per group of ``keys``: the median of every value column, under its name.

    NULL values do not count; a group without values has NULL. Groups with a NULL key are
    groups like others.
    """
    keys = list(keys)
    every = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias(_METRIC), F.col(v).cast("double").alias(_VALUE))
                for i, v in enumerate(values)
            ]
        )
    )
    counted = (
        rows.select(*keys, every.alias("__one"))
        .select(*keys, f"__one.{_METRIC}", f"__one.{_VALUE}")
        .where(F.col(_VALUE).isNotNull())
        .groupBy(*keys, _METRIC, _VALUE)
        .agg(F.count("*").alias(_N))
    )
    group = [*keys, _METRIC]
    found = durable(_read_off(durable(counted), group))
    inner = found.where(F.col(_N).isNull()).select(*group, _VALUE)
    medians = inner.unionByName(_picked(found.where(F.col(_N).isNotNull()), group))
    return medians.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col(_METRIC) == i, F.col(_VALUE))).alias(v) for i, v in enumerate(values)
        ]
    )


def _read_off(counted: DataFrame, group: list[str]) -> DataFrame:
    """The medians of groups inside one range, with a NULL count; and all rows of groups at
    the ends of ranges, with their range and how many values of the group come before in it."""
    order = [F.asc_nulls_first(c) for c in (*group, _VALUE)]
    # The groups of a range are held in one task.
    ranges = counted.repartitionByRange(shuffle_width(counted), *order).sortWithinPartitions(*order)
    ranges = ranges.withColumn(_RANGE, F.spark_partition_id())

    def read_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.num_rows
        new = np.zeros(n, bool)
        new[0] = True
        for c in group:
            codes = table.column(c).combine_chunks().dictionary_encode("encode")
            codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices
            new[1:] |= np.diff(codes.to_numpy(zero_copy_only=False)) != 0
        starts = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        counts = table.column(_N).to_numpy()
        ends = np.cumsum(counts)
        before_group = (ends - counts)[starts]
        totals = np.diff(np.append(before_group, ends[-1]))
        values = table.column(_VALUE).to_numpy()
        at_ends = (number == 0) | (number == len(starts) - 1)
        # Positions of the one or two middle values among all values of the range.
        low, high = (
            values[np.searchsorted(ends, before_group + k, "right")]
            for k in ((totals - 1) // 2, totals // 2)
        )
        inner = starts[1:-1]
        rest = np.flatnonzero(at_ends)
        taken = table.take(pa.array(np.concatenate((inner, rest))))
        blank = np.arange(len(taken)) < len(inner)
        medians = (low * 0.5 + high * 0.5)[1:-1]
        columns = {
            **{c: taken.column(c) for c in group},
            _VALUE: pa.array(np.concatenate((medians, values[rest]))),
            _N: pa.array(taken.column(_N).to_numpy(), mask=blank),
            _RANGE: taken.column(_RANGE),
            _BEFORE: pa.array(
                np.concatenate((np.zeros(len(inner), np.int64), (ends - counts - before_group[number])[rest]))
            ),
        }
        yield from pa.table(columns).to_batches(max_chunksize=1 << 14)

    schema = T.StructType(
        [*(counted.schema[c] for c in group)]
        + [
            T.StructField(_VALUE, T.DoubleType()),
            T.StructField(_N, T.LongType()),
            T.StructField(_RANGE, T.IntegerType()),
            T.StructField(_BEFORE, T.LongType()),
        ]
    )
    return ranges.select(*group, _VALUE, _N, _RANGE).mapInArrow(read_off, schema)


def _picked(rows: DataFrame, group: list[str]) -> DataFrame:
    """Medians of the groups at the ends of ranges."""
    parts = rows.groupBy(*group, _RANGE).agg(F.sum(_N).alias("part"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns(
        {"total": F.sum("part").over(whole), "ahead": F.coalesce(F.sum("part").over(earlier), F.lit(0))}
    )
    middle = F.array_distinct(F.array(F.expr("(total - 1) DIV 2"), F.expr("total DIV 2")))
    wanted = (
        placed.withColumn("k", F.explode(middle))
        .where("k >= ahead AND k < ahead + part")
        .select(*group, _RANGE, (F.col("k") - F.col("ahead")).alias("k"))
    )
    wanted = wanted.toDF(*(f"__wanted_{c}" for c in (*group, _RANGE)), "k")
    same = [F.col(c).eqNullSafe(F.col(f"__wanted_{c}")) for c in (*group, _RANGE)]
    hit = (F.col("k") >= F.col(_BEFORE)) & (F.col("k") < F.col(_BEFORE) + F.col(_N))
    met = rows.join(wanted, [*same, hit]).select(*group, _VALUE)
    return met.groupBy(*group).agg(F.avg(_VALUE).alias(_VALUE))
