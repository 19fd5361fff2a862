"""Pair relations: every record with every other record of its block.

The result of a pair join is quadratic in the block by definition. What can be avoided is
one task holding a large block: blocks over ``tile_rows`` records are laid on a grid of
cells, and the cells are spread over the cluster. Where only the matches, or only counts
of them, are wanted, ``operators.candidates`` reaches them without forming all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import shuffle_width

TILE_ROWS = 4096
#: Large blocks whose sizes are sent to every task.
MOST_SENT = 100_000

_TILES, _ROW, _COLUMN = "__tiles", "__tile_row", "__tile_column"


def ordered(id_column: str) -> Column:
    """Each unordered pair once, the lower id first."""
    return F.col(f"a.{id_column}") < F.col(f"b.{id_column}")


def known(columns: Sequence[str]) -> Column:
    """True for rows with none of the columns NULL."""
    return reduce(lambda x, c: x & F.col(c).isNotNull(), columns, F.lit(True))


def block_sizes(records: DataFrame, block: Sequence[str]) -> DataFrame:
    """Records and pairs per block, known before any pair is formed."""
    sizes = records.groupBy(*block).agg(F.count("*").alias("records"))
    return sizes.withColumn("pairs", pairs_among(F.col("records")))


def pairs_among(n: Column) -> Column:
    """n(n-1)/2, halving the even factor first so that the product stays small."""
    return F.when(n % 2 == 0, F.shiftright(n, 1) * (n - 1)).otherwise(n * F.shiftright(n - 1, 1))


@dataclass(frozen=True)
class Measure:
    """Rows of a relation, in all and in its largest block, and its pairs."""

    total: int
    largest: int
    pairs: int


def measure(records: DataFrame, block: Sequence[str]) -> Measure:
    """One pass over the block columns. Bounds every relation with a subset of the rows."""
    sizes = block_sizes(records, block)
    pairs = F.sum(F.col("pairs").cast("double"))
    row = sizes.agg(F.sum("records"), F.max("records"), pairs).first()
    return Measure(*(int(value or 0) for value in row))


def self_pairs(
    records: DataFrame,
    block: Sequence[str] = ("task_id",),
    id_column: str = "id",
    condition: Column | None = None,
    tile_rows: int = TILE_ROWS,
    bound: Measure | None = None,
) -> DataFrame:
    """Join ``records`` to itself inside each block.

    Columns of the two sides are reached as ``a.<column>`` and ``b.<column>``. The
    condition defaults to ``a.id < b.id``. Rows with a NULL block key form no pair. An
    empty ``block`` pairs all records. A ``bound`` on the sizes saves measuring them when
    it shows that no block is large.
    """
    a, b, keys = _sides(records, list(block), id_column, tile_rows, bound)
    condition = ordered(id_column) if condition is None else condition
    return a.alias("a").join(b.alias("b").hint("merge"), _same(keys) & condition)


def large_blocks(
    records: DataFrame, block: Sequence[str], tile_rows: int, name: str
) -> DataFrame:
    """Blocks over ``tile_rows`` rows and the number of tiles each is cut into."""
    sizes = block_sizes(records, block).filter(F.col("records") > tile_rows)
    return sizes.select(*block, F.ceil(F.col("records") / tile_rows).alias(name))


def with_tiles(
    records: DataFrame, block: Sequence[str], tile_rows: int, name: str, total: int
) -> DataFrame:
    """``records`` with the number of tiles their block is cut into.

    Of ``total`` rows there are at most ``total / tile_rows`` large blocks. That list is sent to
    the rows: a join by the block would first bring all rows of a large one to one task.
    """
    large = large_blocks(records, block, tile_rows, name)
    if total <= MOST_SENT * tile_rows:
        large = F.broadcast(large)
    return records.join(large, list(block), "left").withColumn(name, F.coalesce(name, F.lit(1)))


def _same(keys: Sequence[str], a: str = "a", b: str = "b") -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys])


def _sides(
    records: DataFrame,
    block: list[str],
    id_column: str,
    tile_rows: int,
    bound: Measure | None,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of the join, spread over the cluster, and the columns they meet on."""
    if bound is not None and bound.largest <= tile_rows:
        largest, width = bound.largest, shuffle_width(records, bound.pairs)
    else:
        found = measure(records, block)
        largest, width = found.largest, shuffle_width(records, found.pairs)

    if block and largest <= tile_rows:
        # The same shuffle serves both sides; its width is set by hand because the
        # work grows with the pairs and not with the bytes Spark would coalesce by.
        side = records.repartition(width, *block)
        return side, side, block
    if block:
        sized = with_tiles(records, block, tile_rows, _TILES, found.total)
    else:
        sized = records.withColumn(_TILES, F.lit(-(-largest // tile_rows) or 1))
    # Never NULL, so that no test for it is derived and moved down to the scan.
    cell = F.coalesce(F.pmod(F.xxhash64(id_column), F.col(_TILES)), F.lit(0))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(_TILES) - 1))
    keys = [*block, _ROW, _COLUMN]
    a = sized.withColumn(_ROW, cell).withColumn(_COLUMN, every)
    b = sized.withColumn(_COLUMN, cell).withColumn(_ROW, every)
    return tuple(side.drop(_TILES).repartition(width, *keys) for side in (a, b)) + (keys,)


#: Pairs that a join without a block may form unless a caller allows more.
MOST_PAIRS = 10_000_000_000


@dataclass(frozen=True)
class Cost:
    """What a pair join will form, known before it: pairs in all, the rows and pairs of the
    largest block, the cells that blocks are cut into, and the pairs of the largest cell."""

    rows: int
    pairs: int
    largest_block: int
    largest_pairs: int
    cells: int
    largest_cell: int


def pair_cost(records: DataFrame, block: Sequence[str] = (), tile_rows: int = TILE_ROWS) -> Cost:
    """From the sizes of blocks alone: one aggregation over the block columns.

    A block of n rows is cut into t tiles and t * t cells; the largest cell of the largest
    block holds about (n / t) squared pairs, or half of that if the block is one cell.
    """
    rows = records.where(known(block)) if block else records
    tiles = F.ceil(F.col("records") / tile_rows)
    sizes = block_sizes(rows, block)
    found = sizes.agg(
        F.sum("records").alias("rows"),
        F.sum(F.col("pairs").cast("decimal(38,0)")).alias("pairs"),
        F.max("records").alias("block"),
        F.max("pairs").alias("block_pairs"),
        F.sum(tiles * tiles).alias("cells"),
    ).first()
    rows, pairs, largest, largest_pairs, cells = (int(value or 0) for value in found)
    tile = -(-largest // max(1, -(-largest // tile_rows)))
    return Cost(rows, pairs, largest, largest_pairs, cells, min(largest_pairs, tile * tile))


def all_pairs(
    records: DataFrame,
    id_column: str = "id",
    condition: Column | None = None,
    most: int | None = MOST_PAIRS,
    **tiling,
) -> DataFrame:
    """Pairs without a block: n(n-1)/2 rows when the condition is the default.

    More than ``most`` pairs are an error, raised from the number of rows before any job forms
    pairs; ``None`` allows any number.
    """
    if most is not None:
        cost = pair_cost(records)
        if cost.pairs > most:
            raise ValueError(
                f"{cost.rows} records make {cost.pairs} pairs in {cost.cells} cells of up to"
                f" {cost.largest_cell}; at most {most} are allowed (see `most`)"
            )
    return self_pairs(records, (), id_column, condition, **tiling)
