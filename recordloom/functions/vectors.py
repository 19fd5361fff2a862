"""Vector columns (``array<float>`` or ``array<double>``) and text embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..session import shuffle_width
from .text import col

EMBEDDING_SIZE = 768

#: Adds one vector column per text column: ``embed(df, {"firstname": "firstname_vector"})``.
Embedder = Callable[[DataFrame, Mapping[str, str]], DataFrame]


def dot_product(a, b) -> Column:
    products = F.zip_with(
        col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def vector_norm(v) -> Column:
    return F.sqrt(
        F.aggregate(
            col(v),
            F.lit(0.0),
            lambda acc, x: acc + x.cast("double") * x.cast("double"),
        )
    )


def scaled_to_unit(v, norm=None) -> Column:
    """The vector divided by its length; a zero vector gives NULL elements."""
    norm = vector_norm(v) if norm is None else col(norm)
    return F.transform(col(v), lambda x: F.try_divide(x.cast("double"), norm))


def cosine_similarity(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine of two vectors; NULL for a zero vector.

    Pass norms computed once per record when the vectors take part in many pairs.
    """
    norm_a = vector_norm(a) if norm_a is None else col(norm_a)
    norm_b = vector_norm(b) if norm_b is None else col(norm_b)
    return F.try_divide(dot_product(a, b), norm_a * norm_b)


def vector_sum(*vectors) -> Column:
    """Element-wise sum, as long as the shortest vector."""
    vectors = [col(v) for v in vectors]
    total = vectors[0]
    for v in vectors[1:]:
        total = F.zip_with(total, v, lambda x, y: x + y)
    if len(vectors) == 1:
        return total
    return F.slice(total, F.lit(1), F.least(*[F.size(v) for v in vectors]))


def letter_counts(text) -> Column:
    """26 counts of the letters a-z, ignoring case."""
    lowered = F.lower(col(text))
    letters = F.array(*[F.lit(c) for c in ascii_lowercase])

    def counts(s: Column) -> Column:
        return F.transform(
            letters, lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("float")
        )

    # The outer array holds the one lowered text, so that it is made once and not per letter.
    return F.when(lowered.isNotNull(), F.transform(F.array(lowered), counts)[0])


def embed_letters(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Embedder giving ``letter_counts``; every SQL engine can compute it too."""
    return df.withColumns({vector: letter_counts(text) for text, vector in columns.items()})


def ngram_buckets(text, n: int = 3, size: int = EMBEDDING_SIZE) -> Column:
    """The bucket of every character n-gram of a text, by the gram's MD5: other engines, and
    later versions of Spark, give the same. Words are framed by spaces, so short texts have
    n-grams too; empty text has none, NULL gives NULL."""
    bucket = lambda g: (F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long") % size).cast("int")

    def buckets(framed: Column) -> Column:
        last = F.greatest(F.length(framed) - (n - 1), F.lit(1))
        grams = F.transform(F.sequence(F.lit(1), last), lambda i: bucket(F.substring(framed, i, F.lit(n))))
        return F.when(F.length(framed) > 2, grams).otherwise(F.array())

    framed = F.concat(F.lit(" "), F.lower(F.trim(col(text))), F.lit(" "))
    return F.when(col(text).isNotNull(), _once(framed, buckets))


def sparse_vector(buckets) -> Column:
    """Buckets as a vector of unit length without its zeros: ``indices`` (rising) and
    ``values``."""
    length = lambda counts: F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x * x))

    def counted(b: Column) -> Column:
        indices = F.array_sort(F.array_distinct(b))
        count = lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")
        return F.struct(indices.alias("indices"), F.transform(indices, count).alias("counts"))

    def scaled(s: Column, n: Column) -> Column:
        return F.struct(s["indices"].alias("indices"), F.transform(s["counts"], lambda x: x / n).alias("values"))

    # Arrays of one hold what is used more than once, so that it is made once and not per bucket.
    vector = _once(_once(col(buckets), counted), lambda s: _once(length(s["counts"]), lambda n: scaled(s, n)))
    return F.when(col(buckets).isNotNull(), vector)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def sparse_dot_product(a, b) -> Column:
    """Dot product of two sparse vectors; for unit vectors, their cosine."""
    a, b = col(a), col(b)
    common = F.array_intersect(a["indices"], b["indices"])
    value = lambda v, i: v["values"][F.array_position(v["indices"], i).cast("int") - 1]
    return F.aggregate(common, F.lit(0.0), lambda acc, i: acc + value(a, i) * value(b, i))


def portable_ngrams(n: int = 3, size: int = EMBEDDING_SIZE) -> Embedder:
    """Embedder like ``hashed_ngrams`` whose vectors any engine can compute again.

    Texts are few bytes and their vectors much work, so rows are spread by hand.
    """

    def dense(buckets: pa.Array) -> pa.Array:
        known = buckets.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros((int(known.sum()), size), np.float32)
        sizes = buckets.drop_null().value_lengths().to_numpy(zero_copy_only=False)
        cells = np.repeat(np.arange(len(out)), sizes) * size + buckets.flatten().to_numpy()
        cells, counts = np.unique(cells, return_counts=True)
        lengths = np.sqrt(np.bincount(cells // size, counts * counts, minlength=len(out)))
        out.reshape(-1)[cells] = counts / lengths[cells // size]
        ends = np.concatenate(([0], np.cumsum(known * size)))
        mask = pa.array(~known)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out.reshape(-1)), mask=mask)

    def embed(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
        kept = [c for c in df.columns if c not in columns.values()]
        fields = [*(df.schema[c] for c in kept)]
        fields += [StructField(v, ArrayType(FloatType())) for v in columns.values()]

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = [dense(batch.column(i)) for i in range(len(kept), batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(kept)], *vectors], [*kept, *columns.values()]
                )

        spread = df.repartition(shuffle_width(df))
        buckets = [ngram_buckets(t, n, size).alias(f"__{v}") for t, v in columns.items()]
        filled = spread.select(*(F.col(f"`{c}`") for c in kept), *buckets).mapInArrow(fill, StructType(fields))
        return filled.select(*df.columns, *(v for v in columns.values() if v not in df.columns))

    return embed


def hashed_ngrams(n: int = 3, size: int = EMBEDDING_SIZE) -> Embedder:
    """Embedder giving unit-length counts of hashed character n-grams.

    Words are framed by spaces so that short texts also have n-grams. Empty text gives
    a zero vector, NULL gives NULL.
    """

    def embed(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
        for text, vector in columns.items():
            framed = F.concat(F.lit(" "), F.lower(F.trim(F.col(text))), F.lit(" "))
            grams = F.when(
                F.length(framed) > 2,
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length(framed) - (n - 1), F.lit(1))),
                    lambda i: F.substring(framed, i, F.lit(n)),
                ),
            )
            tokens, counts, unit = (f"__{vector}_{s}" for s in ("tokens", "counts", "unit"))
            df = df.withColumn(
                tokens, F.coalesce(grams, F.array().cast("array<string>"))
            )
            df = HashingTF(inputCol=tokens, outputCol=counts, numFeatures=size).transform(df)
            df = Normalizer(inputCol=counts, outputCol=unit).transform(df)
            df = df.withColumn(
                vector,
                F.when(F.col(text).isNotNull(), vector_to_array(F.col(unit), "float32")),
            ).drop(tokens, counts, unit)
        return df

    return embed
