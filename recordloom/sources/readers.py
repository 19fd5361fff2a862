"""Scans: delimited files and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import COLUMN_SYNONYMS
from . import delimited


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    separator: str = ",",
    synonyms: Mapping[str, Sequence[str]] | None = None,
    on_bad: str = "null",
    place: str | None = None,
) -> DataFrame:
    """File with a header line; columns are found by name, in any order and case.

    Quoted values may hold separators, doubled quotes and line breaks, and a large file is
    read in many tasks all the same (see ``delimited.scan``). A byte order mark and an unnamed
    leading index column are dropped. Text is kept as written (no trimming). With a schema,
    columns the file lacks are left out.

    Of values that do not fit their type, and rows with more or fewer values than names:
    ``on_bad="null"`` makes such values NULL, ``"column"`` also lists them in a column
    ``bad_values`` (see ``bad_value_counts``), and ``"raise"`` is an error that names one.
    ``place`` asks for a column with the file and the record's number in it, to keep the order.
    """
    if on_bad not in ("null", "column", "raise"):
        raise ValueError(f"on_bad: {on_bad!r}")
    rows, names = delimited.scan(spark, path, separator)
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    names = _distinct_names(names)
    parsed = rows.where("number > 1").select(
        F.struct("file", "number").alias(_PLACE),
        delimited.fields("record", names, separator).alias(_VALUES),
    )
    df = parsed.select(
        *[F.col(f"{_VALUES}.c{i}").alias(n) for i, n in enumerate(names)],
        F.when(F.col(f"{_VALUES}.malformed").isNotNull(), F.lit(WIDTH)).alias(_BAD),
        _PLACE,
    )
    if names[0] == "_c0":
        df = df.drop("_c0")
    if synonyms is not None:
        df = rename_synonyms(df, synonyms)
    kept = [c for c in df.columns if c not in (_BAD, _PLACE)]
    found = F.array(F.col(_BAD))
    if schema is not None:
        fields = _present(df, schema)
        found = F.array(F.col(_BAD), *[_misfit(df, c, f) for c, f in fields.items()])
        kept = list(fields)
    bad = F.array_compact(found)
    if on_bad == "raise":
        # checked in the filter, so that no column can be read without it
        refused = F.when(
            F.size(bad) > 0,
            F.raise_error(F.concat(F.lit("values that do not fit: "), F.to_json(bad), F.lit(" in "), F.to_json(_PLACE))),
        )
        df = df.where(refused.cast("boolean").isNull())
    out = df.select(
        *([F.col(f"`{c}`") for c in kept] if schema is None else _cast(df, schema)),
        *([bad.alias("bad_values")] if on_bad == "column" else []),
        *([F.col(_PLACE).alias(place)] if place else []),
    )
    return out


_PLACE, _VALUES, _BAD = "__place", "__values", "__bad"
#: What ``bad_values`` says of a row with more or fewer values than names.
WIDTH = "number of values"


def _distinct_names(names: Sequence[str]) -> list[str]:
    """Names as Spark's own reader gives them: a repeated one with its place, ``_c0`` for none."""
    named = [n or f"_c{i}" for i, n in enumerate(names)]
    lower = [n.lower() for n in named]
    return [f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(named)]


def _present(df: DataFrame, schema: T.StructType) -> dict[str, T.StructField]:
    names = {c.lower(): c for c in df.columns}
    return {names[f.name.lower()]: f for f in schema if f.name.lower() in names}


def _misfit(df: DataFrame, column: str, field: T.StructField) -> Column:
    """``column=value`` if the value does not fit the field's type, else NULL."""
    value = F.col(f"`{column}`")
    misfit = value.isNotNull() & value.try_cast(field.dataType).isNull()
    return F.when(misfit, F.concat(F.lit(f"{field.name}="), value.cast("string")))


def _cast(df: DataFrame, schema: T.StructType) -> list[Column]:
    return [
        F.col(f"`{c}`").try_cast(f.dataType).alias(f.name) for c, f in _present(df, schema).items()
    ]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns that are present, cast, named and ordered as in the schema."""
    return df.select(*_cast(df, schema))


def bad_value_counts(df: DataFrame) -> DataFrame:
    """Rows for each column with values that did not fit: column, bad. ``df`` is a result of
    ``read_delimited(..., on_bad="column")``."""
    return (
        df.select(F.explode("bad_values").alias("value"))
        .groupBy(F.split_part("value", F.lit("="), F.lit(1)).alias("column"))
        .agg(F.count("*").alias("bad"))
    )


def rename_synonyms(
    df: DataFrame, synonyms: Mapping[str, Sequence[str]] = COLUMN_SYNONYMS
) -> DataFrame:
    """Rename known synonyms to their column. Two sources for one column are an error."""
    target = {
        name.lower(): column
        for column, others in synonyms.items()
        for name in (column, *others)
    }
    renames, claimed = {}, {}
    for name in df.columns:
        column = target.get(name.lower())
        if column is None:
            continue
        if column in claimed:
            raise ValueError(f"both {claimed[column]!r} and {name!r} stand for {column!r}")
        claimed[column] = name
        if name != column:
            renames[name] = column
    return df.withColumnsRenamed(renames)


def read_table_columns(spark: SparkSession, table: str, columns: Sequence[str]) -> DataFrame:
    return spark.table(table).select(*columns)


def preview(df: DataFrame, *order_by, rows: int = 5) -> DataFrame:
    """First rows by an explicit order."""
    return df.orderBy(*order_by).limit(rows)
