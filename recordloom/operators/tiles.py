"""Pairs of a block together with their vector similarities.

A join would copy both vectors of every pair to wherever their product is taken, several
kilobytes for a result of a few bytes. Here Spark brings the rows of a block, or of one
cell of a large block's grid, to one task, and the task multiplies whole matrices: each
vector is moved once per cell and not once per pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import shuffle_width
from .pairs import Measure, known, measure, with_tiles

TILE_ROWS = 2048
_STRIP = 64
_BATCH = 1 << 14

_GROUP, _TILE, _LOW, _HIGH, _TILES = "__group", "__tile", "__low", "__high", "__tiles"


def similar_pairs(
    records: DataFrame,
    block: Sequence[str],
    id_column: str,
    similarities: Mapping[str, str | tuple[str, str]],
    above: float | None = None,
    tile_rows: int = TILE_ROWS,
    bound: Measure | None = None,
) -> DataFrame:
    """Pairs ``id_a < id_b`` of each block with the cosine of every named vector column.

    ``similarities`` maps result columns to a vector column, or to two of them when ``a``
    and ``b`` are compared by different ones. All other columns come back as ``<column>_a``
    and ``<column>_b``. A similarity is NULL when a vector is NULL or zero.
    Rows with a NULL id or block have no pairs.
    With ``above``, only pairs whose similarities all lie above it are returned.

    Blocks over ``tile_rows`` rows are cut into tiles and every two tiles meet in a cell
    of their own. Small blocks share a task.
    """
    block = list(block)
    similarities = {n: (v, v) if isinstance(v, str) else v for n, v in similarities.items()}
    vectors = list(dict.fromkeys(v for sides in similarities.values() for v in sides))
    carried = [c for c in records.columns if c not in (*block, id_column, *vectors)]
    rows = records.filter(known([*block, id_column]))
    small = bound is not None and bound.largest <= tile_rows
    found = bound if small else measure(rows, block)
    width = shuffle_width(records, found.pairs)
    placed = _placed(rows, block, id_column, vectors, tile_rows, found, width)

    fields = [records.schema[c] for c in block]
    for c in (id_column, *carried):
        fields += [T.StructField(f"{c}_{s}", records.schema[c].dataType) for s in "ab"]
    fields += [T.StructField(name, T.DoubleType()) for name in similarities]
    segment = [*block, _LOW, _HIGH]

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        order = pc.sort_indices(table, [(c, "ascending") for c in (*segment, id_column)])
        table = table.take(order).combine_chunks()
        return _emit(table, segment, block, [id_column, *carried], similarities, above)

    # Spread by hand: the work grows with the pairs, and few bytes can make many pairs.
    spread = placed.repartition(width, _GROUP)
    return spread.groupBy(_GROUP).applyInArrow(pair_up, T.StructType(fields))


def _placed(
    rows: DataFrame,
    block: list[str],
    id_column: str,
    vectors: list[str],
    tile_rows: int,
    found: Measure,
    width: int,
) -> DataFrame:
    """Rows with their tile, the cell they go to, and the group that handles the cell."""
    groups = max(width, -(-found.total // tile_rows))
    shared = F.pmod(F.xxhash64(*block, F.lit(0)), F.lit(groups))
    if found.largest <= tile_rows:
        zero = F.lit(0).cast("bigint")
        return rows.withColumns({_TILE: zero, _LOW: zero, _HIGH: zero, _GROUP: shared})
    if block:
        rows = with_tiles(rows, block, tile_rows, _TILES, found.total)
    else:
        rows = rows.withColumn(_TILES, F.lit(-(-found.largest // tile_rows)))
    # By the vectors too, so that rows of one id are not all in one tile.
    tile = F.coalesce(F.pmod(F.xxhash64(id_column, *vectors), F.col(_TILES)), F.lit(0))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(_TILES) - 1)).alias("__other")
    rows = rows.withColumn(_TILE, tile).select("*", other)
    rows = rows.withColumns(
        {_LOW: F.least(_TILE, "__other"), _HIGH: F.greatest(_TILE, "__other")}
    )
    cell = F.when(F.col(_TILES) == 1, shared).otherwise(F.xxhash64(*block, _LOW, _HIGH))
    return rows.withColumn(_GROUP, cell).drop("__other", _TILES)


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix, with their lengths (0 for NULL)."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    present = sizes > 0
    if (sizes[present] != width).any():
        raise ValueError("vectors of a column must have the same length")
    matrix = np.zeros((len(lists), max(width, 1)))
    if width:
        values = lists.flatten().to_numpy(zero_copy_only=False)
        matrix[present] = values.reshape(-1, width)
    return matrix, np.sqrt(np.einsum("ij,ij->i", matrix, matrix))


def _run_ends(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """For every row of the sorted table, the end of its run of equal key columns."""
    n = table.num_rows
    starts = np.zeros(n, bool)
    starts[0] = True
    for c in columns:
        values = table.column(c)
        changed = pc.not_equal(values.slice(1), values.slice(0, n - 1))
        starts[1:] |= changed.to_numpy()
    first = np.flatnonzero(starts)
    return np.append(first[1:], n)[np.cumsum(starts) - 1]


def _emit(table, segment, block, sided, similarities, above) -> Iterator[pa.RecordBatch]:
    n = table.num_rows
    if n < 2:
        return
    ends = _run_ends(table, segment)
    # Rows of one id are not paired with each other.
    nexts = _run_ends(table, [*segment, sided[0]])
    tile = table.column(_TILE).to_numpy()
    alike = table.column(_LOW).to_numpy() == table.column(_HIGH).to_numpy()
    compared = {v for sides in similarities.values() for v in sides}
    matrices = {v: matrix(table.column(v)) for v in compared}
    held: list[tuple[np.ndarray, np.ndarray, dict]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        left = np.concatenate([h[0] for h in held])
        right = np.concatenate([h[1] for h in held])
        a, b = (table.select([*block, *sided]).take(pa.array(side)) for side in (left, right))
        columns = {c: a.column(c) for c in block}
        for c in sided:
            columns[f"{c}_a"], columns[f"{c}_b"] = a.column(c), b.column(c)
        for name in similarities:
            scores = np.concatenate([h[2][name] for h in held])
            columns[name] = pa.array(scores, mask=np.isnan(scores))
        return pa.table(columns).combine_chunks().to_batches()[0]

    for start in range(0, n, _STRIP):
        stop = min(start + _STRIP, n)
        reach = int(ends[stop - 1])
        if reach - start < 2:
            continue
        j = np.arange(start, reach)[None, :]
        wanted = (j >= nexts[start:stop, None]) & (j < ends[start:stop, None])
        wanted &= alike[start:stop, None] | (tile[start:stop, None] != tile[None, start:reach])
        products = {}
        for name, (of_a, of_b) in similarities.items():
            (a, norm_a), (b, norm_b) = matrices[of_a], matrices[of_b]
            lengths = norm_a[start:stop, None] * norm_b[None, start:reach]
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = (a[start:stop] @ b[start:reach].T) / lengths
            scores[lengths == 0] = np.nan
            products[name] = scores
            if above is not None:
                wanted &= np.nan_to_num(scores, nan=-np.inf) > above
        rows, columns = np.nonzero(wanted)
        if not len(rows):
            continue
        held.append(
            (rows + start, columns + start, {m: p[rows, columns] for m, p in products.items()})
        )
        size += len(rows)
        if size >= _BATCH:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()
