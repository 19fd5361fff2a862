"""Boilerplate lines: drop lines that too many pages of the same host carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import free_names

RATIO = 0.04
#: A line on fewer pages of a host is no boilerplate, however few pages the host has.
MIN_PAGES = 3
#: Parts into which the lines of one host, and the pages with one line, are dealt.
SALTS = 32


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """128 bits of a line without white space at its ends."""
    return F.unhex(F.md5(F.trim(line, F.lit(" \t\r\u000b\f"))))


def every_salt() -> Column:
    """A row for each part."""
    first, last = F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")
    return F.explode(F.sequence(first, last))


BLANK = "unhex('d41d8cd98f00b204e9800998ecf8427e')"  # the key of an empty line


def page_lines(df: DataFrame, host_column: str, text_column: str, *keep: str) -> DataFrame:
    """A row for each different line of each page that has a host: host, key."""
    keys = F.array_distinct(F.transform(lines_of(F.col(text_column)), line_key))
    return (
        df.where(F.col(host_column).isNotNull())
        .select(*keep, F.col(host_column).alias("host"), F.explode(keys).alias("key"))
        .where(F.col("key") != F.expr(BLANK))
    )


def common_lines(
    df: DataFrame,
    host_column: str = "source",
    text_column: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """Lines on more than ``ratio`` of a host's pages: host, key, pages, host_pages, ratio.

    Lines on fewer than ``min_pages`` pages of a host stay, so nearly all lines are dropped
    before hosts are looked up. The few that are left are dealt over ``SALTS`` parts of
    their host.
    """
    counted = (
        page_lines(df, host_column, text_column)
        .groupBy("host", "key")
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
        .withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    )
    totals = (
        df.where(F.col(host_column).isNotNull())
        .groupBy(F.col(host_column).alias("host"))
        .agg(F.count("*").alias("host_pages"))
        .withColumn("salt", every_salt())
    )
    return (
        counted.join(totals, ["host", "salt"])
        .withColumn("ratio", F.col("pages") / F.col("host_pages"))
        .where(F.col("ratio") > ratio)
        .drop("salt")
    )


def without_common_lines(
    df: DataFrame,
    id_column: str = "doc_id",
    host_column: str = "source",
    text_column: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``df`` with a cleaned text, and the columns n_lines and n_dropped.

    Every different line counts once a page, and every row is a page. Blank lines stay, and so
    do lines on fewer than ``min_pages`` pages and all lines of rows without a host. NULL text
    gives an empty text with one (blank) line. Rows with the same id and host are cleaned
    alike; rows with a NULL id are treated as one id. Columns of ``df`` named n_lines or
    n_dropped are replaced. An empty table gives no rows. A text is split into lines in one
    task, whatever its length; only the keys of its lines travel.

    Only keys of lines travel to find what is common; texts move once, to meet the list of
    their own common lines.
    """
    common = common_lines(df, host_column, text_column, ratio, min_pages).select(
        F.col("host").alias("c_host"), F.col("key").alias("c_key"), every_salt().alias("c_salt")
    )
    lines = page_lines(df, host_column, text_column, F.col(id_column).alias("id")).withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))
    )
    met = lines.join(
        common,
        (F.col("host") == F.col("c_host"))
        & (F.col("key") == F.col("c_key"))
        & (F.col("salt") == F.col("c_salt")),
    )
    # A page's common lines are distinct, and no more than the page has.
    f_id, f_host, f_keys, f_kept = free_names(df, "f_id", "f_host", "f_keys", "f_kept")
    found = met.groupBy(F.col("id").alias(f_id), F.col("host").alias(f_host)).agg(
        F.collect_set("key").alias(f_keys)
    )
    joined = df.join(
        found,
        F.col(id_column).eqNullSafe(F.col(f_id)) & (F.col(host_column) == F.col(f_host)),
        "left",
    )
    lines = lines_of(F.col(text_column))
    kept = F.when(F.col(f_keys).isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.array_contains(F.col(f_keys), line_key(x)))
    )
    out = joined.withColumn(f_kept, kept).withColumns(
        {
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": (F.size(lines) - F.size(f_kept)).cast("long"),
        }
    )
    return out.withColumn(text_column, F.array_join(f_kept, "\n")).drop(
        f_id, f_host, f_keys, f_kept
    )


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, text FROM documents
), l AS (
  SELECT r, doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM d
), k AS (
  SELECT *, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS key FROM l
), t AS (
  SELECT source, count(*) AS host_pages FROM documents GROUP BY source
), c AS (
  SELECT k.source, k.key FROM k JOIN t USING (source)
  WHERE k.key <> ''
  GROUP BY k.source, k.key, t.host_pages
  HAVING count(DISTINCT k.r) >= {MIN_PAGES} AND count(DISTINCT k.r) / t.host_pages > {RATIO}
), m AS (
  SELECT k.r, k.doc_id, k.line, k.place, c.key IS NOT NULL AS gone
  FROM k LEFT JOIN c ON k.source = c.source AND k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), ''))
         AS text_sha256
FROM m GROUP BY r, doc_id
"""
