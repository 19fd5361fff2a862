"""Whole plans: from a file of records to groups, and from members to predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors
from ..functions.vectors import Embedder, hashed_ngrams
from ..operators import candidates, features, groups, model, rules
from ..operators.cosine import near_vectors
from ..schemas import COLUMN_SYNONYMS, RECORD_FILE, RECORD_VECTORS
from ..session import durable
from ..sources.readers import read_delimited, read_table_columns
from ..sources.writers import add_missing_columns, embed_columns, overwrite, with_dense_id

ORIGINAL_COLUMNS = ("id", "task_id", "firstname", "lastname", "dob", "gender", "country")


def load_records(spark: SparkSession, path: str, table: str, on_bad: str = "raise") -> DataFrame:
    """Read a file of records into a table, with ids in the order of the file.

    A value that does not fit its column is an error, unless ``on_bad`` is ``null``.
    """
    rows = read_delimited(spark, path, RECORD_FILE, synonyms=COLUMN_SYNONYMS, place="place", on_bad=on_bad)
    missing = {f.name: f.dataType for f in RECORD_FILE if f.name != "id"}
    overwrite(with_dense_id(add_missing_columns(rows, missing), "place").drop("place"), table)
    return spark.table(table)


def match_and_group(
    records: DataFrame,
    embed: Embedder | None = None,
    limits: rules.Thresholds = rules.Thresholds(),
    exclude_no_match: bool = False,
    keep_unpaired: bool = False,
) -> DataFrame:
    """Grouped records with their originals.

    ``No Match`` is a label like the others and can be chosen as a group. With
    ``exclude_no_match`` the pairs that fail every rule are neither grouped nor formed;
    records that match nothing are then in no pair, see ``keep_unpaired``.
    """
    embedded = records if embed is None else embed_columns(records, embed)
    if exclude_no_match:
        labelled = candidates.matched_pairs(embedded, limits=limits)
    else:
        scored = rules.scored_pairs(embedded, with_text=False)
        labelled = rules.label_pairs(scored, limits)
    return groups.grouped_records(
        labelled, records.select(*ORIGINAL_COLUMNS), keep_unpaired=keep_unpaired
    )


@dataclass(frozen=True)
class FileMatch:
    pairs: DataFrame
    originals: DataFrame
    grouped: DataFrame


def match_file(
    spark: SparkSession,
    path: str,
    table: str,
    embed: Embedder | None = None,
    on_bad: str = "raise",
    **options,
) -> FileMatch:
    """Upload a file, embed it, match all pairs of a task and group them."""
    load_records(spark, path, table, on_bad)
    embedded = durable(embed_columns(spark.table(table), embed or hashed_ngrams()))
    return FileMatch(
        pairs=rules.with_display_names(rules.match_pairs(embedded)),
        originals=read_table_columns(spark, table, ORIGINAL_COLUMNS),
        grouped=match_and_group(embedded, **options),
    )


def name_similarity(
    records: DataFrame,
    embed: Embedder,
    above: float = 0.8,
    high: float = 0.9,
    digits: int = 10,
) -> DataFrame:
    """Scores above a limit between records of different first names, both ways round.

    The score is the dot product of the summed unit vectors, brought to unit length.
    Records alike in first name and vector are one row before they are compared, and
    every result row carries the number of record pairs it stands for.
    """
    fold = {"copies": F.count("*"), "id": F.min("id")}
    folded = records.groupBy(*RECORD_VECTORS).agg(*[c.alias(n) for n, c in fold.items()])
    embedded = embed(folded, RECORD_VECTORS)
    sized = embedded.withColumns(
        {f"{v}_norm": vectors.vector_norm(v) for v in RECORD_VECTORS.values()}
    )
    units = [vectors.scaled_to_unit(v, f"{v}_norm") for v in RECORD_VECTORS.values()]
    summed = sized.withColumn("full_vector", vectors.vector_sum(*units))
    names = summed.groupBy("firstname", "full_vector").agg(
        F.sum("copies").alias("copies"), F.min("id").alias("id")
    )
    # The limit is meant for rounded scores, so pairs just below it are still let through.
    near = near_vectors(names, (), "id", "full_vector", "score", above - 10**-digits)
    score = F.round("score", digits)
    a, b = F.col("firstname_a"), F.col("firstname_b")
    both = F.inline(
        F.array(
            F.struct(a.alias("first_record"), b.alias("second_record")),
            F.struct(b.alias("first_record"), a.alias("second_record")),
        )
    )
    return (
        near.filter((a != b) & (score > above))
        .select(both, score.alias("similarity_score"), (F.col("copies_a") * F.col("copies_b")).alias("pairs"))
        .groupBy("first_record", "second_record", "similarity_score")
        .agg(F.sum("pairs").alias("pairs"))
        .withColumn("pattern_group", rules.score_band("similarity_score", high))
    )


@dataclass(frozen=True)
class Supervised:
    features: DataFrame
    trained: model.Trained
    predictions: DataFrame
    evaluation: model.Evaluation


def supervised_matching(members: DataFrame, embed: Embedder | None = None, **training) -> Supervised:
    """Keys, pair features, task statistics, a classifier, its predictions, and how it does on
    the tasks held out of its training."""
    keys = features.member_keys(members, embed or hashed_ngrams())
    table = durable(features.task_features(features.pair_features(keys), members))
    trained = model.train(table, **training)
    predictions = model.predict(trained, table.drop(features.LABEL))
    return Supervised(table, trained, predictions, model.evaluation(trained))
