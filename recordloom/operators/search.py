"""Similarity search over a vector column."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import vectors
from .tiles import matrix

#: Rows, and queries, of a cell.
TILE_ROWS, TILE_QUERIES = 8192, 1024
_STRIP = 64


def similar_rows(
    rows: DataFrame,
    vector: str,
    query: Column | Sequence[float],
    tie_break: str,
    above: float = 0.7,
    limit: int = 5,
    recent: Column | None = None,
) -> DataFrame:
    """The ``limit`` rows most similar to the query vector, best first.

    ``recent`` is tested before any similarity is computed. Every task keeps its best
    ``limit`` rows only.
    """
    if not isinstance(query, Column):
        query = F.array(*[F.lit(float(x)) for x in query])
    kept = rows if recent is None else rows.filter(recent)
    scored = kept.withColumn("similarity", vectors.cosine_similarity(vector, query))
    return (
        scored.filter(F.col("similarity") > above)
        .orderBy(F.col("similarity").desc(), F.col(tie_break))
        .limit(limit)
    )


def query_vector(spark, text: str, embed: vectors.Embedder) -> list[float]:
    """Vector of one query text, by the embedder that filled the table."""
    one = embed(spark.createDataFrame([(text,)], "text string"), {"text": "vector"})
    return [float(x) for x in one.first()["vector"]]


def similar_rows_of_each(
    rows: DataFrame,
    queries: DataFrame,
    vector: str,
    id_column: str,
    limit: int = 5,
    digits: int = 9,
    tile_rows: int = TILE_ROWS,
    tile_queries: int = TILE_QUERIES,
) -> DataFrame:
    """The ``limit`` most similar rows for every query: query_id, rank, the row's id, similarity.

    Both sides have ``id_column`` and ``vector``. Rows and queries are dealt to tiles, and every
    two tiles meet in a cell of their own, where one matrix product scores them and each query
    keeps its best ``limit``; the best of all cells are merged by query. Every row is compared,
    so the result is exact. Similarities are rounded to ``digits`` before they are ranked, and
    ties go to the lower id. NULL ids, NULL vectors and zero vectors are left out; a query
    without comparable rows has no result rows.
    """
    known = lambda df: df.select(id_column, vector).where(
        F.col(id_column).isNotNull() & (vectors.vector_norm(vector) > 0)
    )
    rows, queries = known(rows), known(queries)
    tiles = [
        max(1, -(-df.count() // size)) for df, size in ((rows, tile_rows), (queries, tile_queries))
    ]
    cells = []
    for df, own, other in ((rows, 0, 1), (queries, 1, 0)):
        mine = F.pmod(F.xxhash64(id_column), F.lit(tiles[own])).alias(f"tile_{own}")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles[other] - 1).cast("long")))
        cells.append(
            df.select(
                F.col(id_column).alias("id"), F.col(vector).alias("vector"), mine, every.alias(f"tile_{other}")
            ).groupBy("tile_0", "tile_1")
        )

    def best(some: pa.Table, asked: pa.Table) -> pa.Table:
        found = {"query_id": [], "id": [], "similarity": []}
        if some.num_rows and asked.num_rows:
            (a, norm_a), (b, norm_b) = (matrix(t.column("vector")) for t in (asked, some))
            a, b = a / norm_a[:, None], b / norm_b[:, None]
            ids = some.column("id").combine_chunks()
            order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")  # ties by id
            b, ids = b[order], ids.take(pa.array(order))
            for start in range(0, len(a), _STRIP):
                scores = np.round(a[start : start + _STRIP] @ b.T, digits)
                k = min(limit, scores.shape[1])
                least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                for i, (line, low) in enumerate(zip(scores, least, strict=True)):
                    near = np.flatnonzero(line >= low)
                    near = near[np.argsort(-line[near], kind="stable")[:k]]
                    found["query_id"] += [start + i] * len(near)
                    found["id"].append(near)
                    found["similarity"].append(line[near])
            queried = asked.column("id").take(pa.array(found["query_id"]))
            places = pa.array(np.concatenate(found["id"]))
            return pa.table(
                {
                    "query_id": queried,
                    "id": ids.take(places),
                    "similarity": np.concatenate(found["similarity"]),
                }
            )
        kind = (some if some.num_columns else asked).schema.field("id").type
        return pa.table({c: pa.array([], t) for c, t in zip(found, (kind, kind, pa.float64()), strict=True)})

    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema[id_column].dataType),
            T.StructField("id", rows.schema[id_column].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    met = cells[0].cogroup(cells[1]).applyInArrow(best, schema)
    in_order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return (
        met.withColumn("rank", F.row_number().over(in_order))
        .where(F.col("rank") <= limit)
        .select("query_id", "rank", F.col("id").alias(id_column), "similarity")
    )
