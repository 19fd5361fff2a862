"""Views over the given tables that stand in for person records.

The given tables hold no people, so part names play first and last names, in blocks of
ten. Nothing is left out: every row of the source table becomes a row of the view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vectors import embed_letters
from ..schemas import RECORD_VECTORS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person records from ``part``, with NULL birth dates and genders among them."""
    key, size = F.col("p_partkey"), F.col("p_size")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    return table(spark, sf_dir, "part").select(
        F.floor(key / 10).alias("task_id"),
        key.alias("id"),
        F.when(key % 3 == 0, F.reverse(first)).otherwise(first).alias("firstname"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("lastname"),
        F.col("p_brand").alias("address"),
        F.when(key % 7 != 0, F.concat(F.lit("2012070"), (size % 3).cast("string"))).alias("dob"),
        F.when(key % 11 != 0, F.when(size % 2 == 0, "M").otherwise("F")).alias("gender"),
        F.lit("India").alias("country"),
    )


def embedded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_letters(records(spark, sf_dir), RECORD_VECTORS)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member records with a 0/1 label per task; in some tasks one record disagrees."""
    key, size = F.col("p_partkey"), F.col("p_size")
    task = F.floor(key / 10)
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    disagrees = key % 100 == 5
    return table(spark, sf_dir, "part").select(
        task.cast("string").alias("task_id"),
        key.cast("string").alias("mcid"),
        F.when(key % 3 == 0, F.reverse(first)).otherwise(first).alias("first_name"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("last_name"),
        F.char(size % 26 + 65).alias("middle_initial"),
        F.when(key % 11 != 0, F.when(size % 2 == 0, "M").otherwise("F")).alias("gender"),
        F.when(key % 7 != 0, F.date_add(F.lit("1950-01-01").cast("date"), size * 20)).alias("dob"),
        F.when(disagrees, 1 - task % 2).otherwise(task % 2).alias("response_final"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("task_id"), F.col("vec_id").alias("id"), "embedding"
    )


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a 0/1 label, a probability and the class it gives."""
    probability = F.round(F.col("n_chars") / (F.col("n_chars") + 200.0), 4)
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(
        table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"
    )
    return joined.select(
        "doc_id",
        F.col("quality").alias("label"),
        probability.alias("probability"),
        (probability > 0.5).cast("int").alias("predicted"),
    )


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows with gaps: the key, a text column and a number column."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.nullif(F.floor(F.col("value") / 10), F.lit(0)).alias("tens"),
    )
