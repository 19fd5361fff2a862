"""Pairs of vectors above a cosine limit, through an inverted index of coordinates.

Let the coordinates of all vectors be ordered, the rarest first. If the first coordinate that
two unit vectors have in common is c, their cosine is at most the product of what remains of
their lengths from c on. So a vector is listed only under coordinates from which at least the
limit of its length remains, mostly one to three of its rarest, and two vectors that are
nowhere in one list are known to lie below the limit. Vectors of one list are compared by
matrix products (see ``tiles``), and lists of any size are cut into cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import durable
from .pairs import Measure, known, measure
from .tiles import matrix, similar_pairs

_LIST = "__coordinate"
#: Lengths and products are rounded; a vector this close to the limit is still listed.
_ROUNDING = 1e-9
_ROWS = 1024


def near_vectors(
    rows: DataFrame, block: Sequence[str], id_column: str, vector: str, score: str, above: float
) -> DataFrame:
    """Pairs ``id_a < id_b`` of a block whose cosine lies above the limit, as ``similar_pairs``
    gives them: other columns come back as ``<column>_a`` and ``<column>_b``.

    Only vectors that share a list are compared. Where the lists would hold more pairs than
    the blocks themselves (vectors without zeros, low limits), the blocks are compared: the
    rows are the same, and ``compared`` tells which it is.
    """
    found, lists = _listed(rows, block, vector, above, id_column)
    if found is None:
        return similar_pairs(rows, block, id_column, {score: vector}, above)
    pairs = similar_pairs(found, [*block, _LIST], id_column, {score: vector}, above, bound=lists)
    return pairs.drop(_LIST).dropDuplicates([*block, f"{id_column}_a", f"{id_column}_b"])


def compared(
    rows: DataFrame, block: Sequence[str], id_column: str, vector: str, above: float
) -> tuple[int, int]:
    """Pairs that ``near_vectors`` compares, and pairs that the blocks hold."""
    every = measure(rows.where(known([*block, id_column])), block).pairs
    found, lists = _listed(rows, block, vector, above, id_column)
    return (every if found is None else lists.pairs), every


def _listed(
    rows: DataFrame, block: Sequence[str], vector: str, above: float, id_column: str
) -> tuple[DataFrame | None, Measure | None]:
    """Rows once for each list they are in, and the lists' sizes; None if blocks are cheaper."""
    if above <= 0:
        return None, None
    # Written before vectors are looked at: a filter on a vector that is still an expression would
    # move down to the rows it is made from, below any folding, and make every one's vector there.
    rows = durable(rows.where(known([*block, id_column]))).where(F.size(vector) > 0)
    listed = durable(postings(rows, vector, above))
    lists, whole = measure(listed, [*block, _LIST]), measure(rows, block)
    return (listed, lists) if lists.pairs < whole.pairs else (None, None)


def _signed(column: pa.Array) -> np.ndarray:
    """Unit vectors, with a column for either sign of a coordinate: products of unlike signs
    only lower a cosine."""
    values, lengths = matrix(pa.chunked_array([column]))
    lengths[lengths == 0] = 1
    unit = values / lengths[:, None]
    return np.concatenate((np.maximum(unit, 0), np.maximum(-unit, 0)), axis=1)


def _order(rows: DataFrame, vector: str) -> np.ndarray:
    """Signed coordinates, the rarest first. At most two numbers for each are gathered."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = sum(
                    (_signed(batch.column(0).slice(i, _ROWS)) > 0).sum(axis=0)
                    for i in range(0, batch.num_rows, _ROWS)
                )
                places = np.arange(len(n))
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(n)], ["place", "n"])

    counts = rows.select(vector).mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found = sorted((r.n, r.place) for r in counts.collect())
    return np.array([place for _, place in found], np.int64)


def postings(rows: DataFrame, vector: str, above: float) -> DataFrame:
    """Every row once for each signed coordinate from which ``above`` of its length remains."""
    order = _order(rows, vector)
    names = rows.columns

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                sorted_ = _signed(part.column(names.index(vector)))[:, order]
                remains = np.cumsum(sorted_[:, ::-1] ** 2, axis=1)[:, ::-1]
                row, place = np.nonzero((sorted_ > 0) & (remains >= (above - _ROUNDING) ** 2))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(order[place].astype(np.int32))], [*names, _LIST]
                )

    schema = T.StructType([*rows.schema.fields, T.StructField(_LIST, T.IntegerType())])
    return rows.mapInArrow(post, schema)
