"""Delimited files whose quoted values hold line breaks, read in splits.

Whether a line break ends a record depends on the quotes before it: it does where their
number is even. A first pass counts the quotes and possible record ends of every split of a
file; a running sum over the splits, one small row each, tells how each begins; a second pass
then cuts records in all splits at once. Only the lines of records that hold line breaks are
brought together by a shuffle.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import stored

FILE, NUMBER = "file", "number"


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Physical lines with their file and the start of their split, in order inside a split."""
    scan = spark.read.option("lineSep", "\n").text(path)
    return scan.select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Parts of a batch that come from one split."""
    n = batch.num_rows
    if not n:
        return
    changed = np.zeros(n, bool)
    for c in (FILE, "start"):
        column = batch.column(c)
        changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    cuts = [0, *np.flatnonzero(changed).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        part = batch.slice(a, b - a)
        yield (part.column(FILE)[0].as_py(), part.column("start")[0].as_py()), part


def _quotes(part: pa.RecordBatch) -> np.ndarray:
    return pc.count_substring(part.column("value"), '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _splits(lines: DataFrame) -> DataFrame:
    """Of each split: file, start, quotes, the lines that follow an even or odd number, and the
    first line."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, quotes, after, head = None, 0, [0, 0], ""

        def answer() -> pa.RecordBatch:
            values = [held[0], held[1], quotes, *after, head]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names)

        names = [FILE, "start", "quotes", "after_even", "after_odd", "head"]
        for batch in batches:
            for split, part in _runs(batch):
                if split != held:
                    if held is not None:
                        yield answer()
                    held, quotes, after = split, 0, [0, 0]
                    head = part.column("value")[0].as_py()
                own = _quotes(part)
                before = (quotes + np.cumsum(own) - own) % 2
                after[1] += int(before.sum())
                after[0] += len(before) - int(before.sum())
                quotes += int(own.sum())
        if held is not None:
            yield answer()

    schema = f"{FILE} string, start long, quotes long, after_even long, after_odd long, head string"
    return lines.mapInArrow(count, schema)


def _begun(splits: DataFrame) -> DataFrame:
    """How each split begins: inside quotes or not, and the records begun before it."""
    earlier = Window.partitionBy(FILE).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.coalesce(F.sum("quotes").over(earlier), F.lit(0))
    begun = F.when(F.col("odd"), F.col("after_odd")).otherwise(F.col("after_even"))
    return (
        splits.withColumn("odd", quotes % 2 == 1)
        .withColumn("begun", begun)
        .withColumn("before", F.coalesce(F.sum("begun").over(earlier), F.lit(0)))
        .select(FILE, "start", "odd", "before")
    )


def scan(spark: SparkSession, path: str | Sequence[str], separator: str) -> tuple[DataFrame, list[str]]:
    """``file, number, record`` of delimited files, and the column names of their headers.

    Records are numbered from 1 in each file; the first is the header. A record ends at a line
    break (``\\n`` or ``\\r\\n``) that is not inside quotes; empty lines are numbered, but left
    out. Quotes inside a value are doubled, and a value that holds one is quoted. Files whose
    quotes do not close or whose headers differ are an error, found before records are cut.
    """
    lines = _lines(spark, path)
    splits = stored(_splits(lines))
    unclosed = splits.groupBy(FILE).agg(F.sum("quotes").alias("quotes")).where("quotes % 2 = 1")
    broken = unclosed.select(FILE).take(1)
    if broken:
        raise ValueError(f"a quote is not closed in {broken[0][0]}")
    rows = _cut(lines, _begun(splits))
    heads = splits.where("start = 0").select("head").distinct().take(2)
    if any(h[0].count('"') % 2 for h in heads):  # a header of several lines
        heads = rows.where(F.col(NUMBER) == 1).select("record").distinct().take(2)
    if len(heads) > 1:
        raise ValueError(f"files with different headers: {heads[0][0]!r} and {heads[1][0]!r}")
    if not heads:
        return rows, []
    head = heads[0][0].removesuffix("\r").removeprefix("\ufeff")
    return rows, next(csv.reader(head.splitlines(keepends=True), delimiter=separator), [])


def _cut(lines: DataFrame, begun: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, quotes, number, place = None, 0, 0, 0
        for batch in batches:
            for split, part in _runs(batch):
                if split != held:
                    held, place = split, 0
                    quotes = int(part.column("odd")[0].as_py())
                    number = part.column("before")[0].as_py()
                own = _quotes(part)
                inside = (quotes + np.cumsum(own) - own) % 2
                numbers = number + np.cumsum(inside == 0)
                whole = (inside == 0) & (own % 2 == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(FILE),
                        pa.array(numbers),
                        part.column("start"),
                        pa.array(place + np.arange(len(own))),
                        part.column("value"),
                        pa.array(whole),
                    ],
                    [FILE, NUMBER, "start", "place", "value", "whole"],
                )
                quotes += int(own.sum())
                number, place = int(numbers[-1]), place + len(own)

    schema = f"{FILE} string, {NUMBER} long, start long, place long, value string, whole boolean"
    # One row for each split of the files: some dozen bytes for every 128 MB.
    placed = lines.join(F.broadcast(begun), [FILE, "start"]).select(FILE, "start", "value", "odd", "before")
    cut_lines = placed.mapInArrow(cut, schema)
    joined = (
        cut_lines.where("NOT whole")
        .groupBy(FILE, NUMBER)
        .agg(F.array_sort(F.collect_list(F.struct("start", "place", "value"))).alias("lines"))
        .select(FILE, NUMBER, F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"))
    )
    every = cut_lines.where("whole").select(FILE, NUMBER, F.col("value").alias("record")).union(joined)
    return every.withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> ''")


def fields(record: str | Column, names: Sequence[str], separator: str) -> Column:
    """The values of a record as a struct of texts ``c0, c1, ...`` and ``malformed``.

    ``malformed`` holds the record if it has more or fewer values than names. Empty values
    are NULL unless quoted.
    """
    # an empty value without quotes is told from "" by a text that files do not hold
    nothing = "\u0000"
    schema = ", ".join([*(f"c{i} string" for i in range(len(names))), "malformed string"])
    options = {
        "sep": separator,
        "escape": '"',
        "nullValue": nothing,
        "emptyValue": "",
        "multiLine": "true",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "malformed",
    }
    return F.from_csv(record, schema, options)
