"""Documents made ready for training, in stages that write what they keep."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import bpe, decontamination, exact_dedup, minhash, toxicity
from recordloom.llm.queries import TOKENIZER, table
from recordloom.session import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier takes for toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, similarity 0.8.

    13 of 32 coordinates have to agree: a pair of similarity 0.8 is missed twice in ten million.
    """
    return minhash.one_of_each(docs, width=5, similarity=80, matches=13)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids (32-bit little-endian) and the text they decode to."""
    coded = bpe.encoded(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return coded.withColumn("n_tokens", bpe.n_tokens(coded["ids"])).select(
        "doc_id", "n_tokens", "ids", "decoded"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("tokens", tokens),
]

#: Classifier, near duplicates and tokenizer are not expressible in SQL; tests hold run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages leave of ``documents``; each stage is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
