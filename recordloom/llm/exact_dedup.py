"""Exact copies: group by a 128-bit content hash, compare bytes inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import free_names

#: Characters that do not count when texts are compared: [\x20\x09-\x0D].
WHITE = " \t\n\u000b\f\r"
LARGEST = str(2**63)
STEP = str(2**65)
#: Columns of ``classes_of`` that name the row that stays.
KEPT = ("keep_id", "hash", "text_sha256", "keep_length")


def normalised(text: Column) -> Column:
    """The text without white space; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def content_hash(text: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(text))


def _rank(length: Column, key: Column) -> Column:
    """One number that is larger for longer texts, then for smaller ids, NULL last.

    A number, so that Spark keeps it in a hash aggregation and never sorts texts.
    """
    wide = "decimal(38,0)"
    place = F.lit(LARGEST).cast("decimal(20,0)") - key.cast("decimal(20,0)")
    return (
        length.cast("decimal(10,0)") * F.lit(STEP).cast("decimal(21,0)")
        + F.coalesce(place, F.lit(0).cast("decimal(21,0)"))
    ).cast(wide)


def classes_of(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    hashed=content_hash,
) -> DataFrame:
    """One row per distinct text: hash, text_sha256, keep_id, keep_length, group_size.

    The aggregation key holds hash and text, so texts that only share the hash stay apart.
    Copies are counted in the tasks that read them: each task passes on one row per text,
    however many copies there are.
    """
    text = normalised(F.col(text_column))
    length = F.length(F.coalesce(F.col(text_column), F.lit("")))
    read = df.select(
        text.alias("body"), _rank(length, F.col(id_column).cast("long")).alias("rank")
    ).withColumn("hash", hashed(F.col("body")))
    grouped = read.groupBy("hash", "body").agg(
        F.max("rank").alias("best"), F.count("*").alias("group_size")
    )
    step = F.lit(STEP).cast("decimal(38,0)")
    place = F.col("best") % step
    return grouped.select(
        "hash",
        F.sha2(F.encode("body", "utf-8"), 256).alias("text_sha256"),
        F.when(place > 0, (F.lit(LARGEST).cast("decimal(38,0)") - place).cast("long")).alias(
            "keep_id"
        ),
        ((F.col("best") - place) / step).cast("long").alias("keep_length"),
        "group_size",
    )


def keyed(
    df: DataFrame, id_column: str, text_column: str, hashed=content_hash
) -> DataFrame:
    """id, hash, text_sha256 and length of every row."""
    text = normalised(F.col(text_column))
    return df.select(
        F.col(id_column).cast("long").alias("id"),
        hashed(text).alias("hash"),
        F.sha2(F.encode(text, "utf-8"), 256).alias("text_sha256"),
        F.length(F.coalesce(F.col(text_column), F.lit(""))).cast("long").alias("length"),
    )


def exact_copies(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    hashed=content_hash,
) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the longest original stays, then the smallest id. NULL texts count as
    empty. Rows with a NULL id come last in a group and are dropped only if another row
    stays. Of rows that repeat both id and text one is kept. An empty table gives no rows;
    other columns of ``df`` are not read.
    """
    repeated = keyed(df, id_column, text_column, hashed).groupBy(
        "id", "hash", "text_sha256", "length"
    ).agg(F.count("*").alias("times"))
    found = repeated.join(classes_of(df, id_column, text_column, hashed), ["hash", "text_sha256"])
    first = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))
    return found.select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        first.alias("first"),
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"),
        "text_sha256",
    ).select(
        id_column,
        "keep_id",
        "group_size",
        (F.col("first") & (F.col("time") == 1)).alias("kept"),
        "text_sha256",
    )


def without_copies(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", hashed=content_hash
) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Rows meet their class by id, so a large group of copies is not gathered anywhere.
    """
    text = normalised(F.col(text_column))
    values = (
        F.col(id_column).cast("long"),
        hashed(text),
        F.sha2(F.encode(text, "utf-8"), 256),
        F.length(F.coalesce(F.col(text_column), F.lit(""))).cast("long"),
    )
    own = free_names(df, "own_id", "own_hash", "own_sha", "own_length", "own_place")
    key, place = own[:4], own[4]
    stay = classes_of(df, id_column, text_column, hashed).select(
        *(F.col(a).alias(f"{b}_kept") for a, b in zip(KEPT, key, strict=True))
    )
    same = [F.col(a).eqNullSafe(F.col(f"{a}_kept")) for a in key]
    met = df.withColumns(dict(zip(key, values, strict=True))).join(
        stay, same[0] & same[1] & same[2] & same[3], "left_semi"
    )
    order = Window.partitionBy(*key).orderBy(key[3])
    return (
        met.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(*own)
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), k AS (
  SELECT body, arg_max(doc_id, n * 1000000000000 - doc_id) AS keep_id, count(*) AS group_size
  FROM t GROUP BY body
)
SELECT t.doc_id, k.keep_id, k.group_size, t.doc_id = k.keep_id AS kept,
       sha256(t.body) AS text_sha256
FROM t JOIN k ON t.body = k.body
"""
