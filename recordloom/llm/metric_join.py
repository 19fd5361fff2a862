"""Jaccard similarity join in the metric space of shingle sets, by pivots.

Jaccard distance obeys the triangle inequality. With the radius r of a link, every round
elects pivots among the points that are left, and measures every point within 3r of one.
Points within 2r of a pivot go to the Voronoi region of the nearest and leave (from the second
round on, which finds sparse points, those within r, and 2r are measured). A link of such a
point leads to a point measured from its pivot: these boundary points are copied into the
region's window, and of them only those are compared whose distances to the pivot differ by
at most r. Points of a region are told apart by their differences from the pivot, which are
small. What lies beyond all pivots is joined recursively with new ones, until no point is
left. Points that share too few shingles with the others that are left have no link, and go
before pivots are elected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .words import U64, blocks, hash_words, mix, text_bytes

WIDTH = 3
#: Least similarity of linked documents, in hundredths.
SIMILARITY = 90
#: Elections in a row: a pivot is first among those with its least shingle in every one.
ELECTIONS = 3
#: Points of a cell on either side.
TILE = 1024
#: Shingles whose owners are compared in one place.
BUCKET = 1 << 20
#: Of so many points one is counted to tell frequent shingles, and so many of them come last.
COUNTED, FREQUENT = 16, 1 << 16
#: Rounds whose regions reach twice as far as links; what is left after them is sparse.
WIDE = 1

SETS = "id long, n_shingles long, set_key binary"
DEALT = "bucket long, nodes binary, parts binary"


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    for first, last in blocks(offsets):
        base = offsets[first]
        part = hash_words(data[base : offsets[last]], offsets[first : last + 1] - base)
        found, starts = part.shingles(width)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield np.unique(found[a:b])


def key_of(points: np.ndarray) -> bytes | None:
    return hashlib.blake2b(points.tobytes(), digest_size=16).digest() if len(points) else None


def least_shared(n: int, similarity: int) -> tuple[int, int]:
    """How many of its first shingles a set of ``n`` lists, and how many of them a similar one has.

    Sets of this similarity share at least o = similarity * n / 100 shingles. So of the first
    n - o + c of both, in any common order, they share c. ``c`` is a tenth of n.
    """
    o = -(-similarity * n // 100)
    c = max(1, n // 10)
    return min(n, n - o + c), c


def signed(df: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """id, n_shingles and set_key of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for points in shingle_sets(batch.column(1), width):
                sizes.append(len(points))
                keys.append(key_of(points))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())],
                ["id", "n_shingles", "set_key"],
            )

    read = df.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")
    )
    return read.mapInArrow(run, SETS)


def _dealt(owners: list[int], prefixes: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Shingles and who has them, packed by bucket."""
    owner = np.repeat(np.array(owners, "<i8"), [len(x) for x in prefixes])
    flat = np.concatenate([np.zeros(0, U64), *prefixes])
    bucket = (mix(flat) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    numbers, cuts = np.unique(bucket[order], return_index=True)
    packed = [
        [x.tobytes() for x in np.split(values, cuts[1:])] if len(numbers) else []
        for values in (owner[order], (flat[order] >> U64(32)).astype("<u4"))
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int64()), *(pa.array(p, pa.binary()) for p in packed)],
        ["bucket", "nodes", "parts"],
    )


def _owner(key: bytes) -> int:
    """64 bits of a set's key: equal sets are one owner."""
    return int.from_bytes(key[:8], "big", signed=True)


def dealt_texts(df: DataFrame, text_column: str, width: int, similarity: int, buckets: int) -> DataFrame:
    """The first shingles of every text, dealt to buckets; a set is named by 64 bits of its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for x in shingle_sets(batch.column(0), width) if len(x)]
            first = [x[: least_shared(len(x), similarity)[0]] for x in found]
            yield _dealt([_owner(key_of(x)) for x in found], first, buckets)

    return df.select(F.col(text_column).cast("string").alias("text")).mapInArrow(run, DEALT)


def dealt_points(points: DataFrame, similarity: int, buckets: int) -> DataFrame:
    """The first shingles of points (node, shingles), dealt to buckets."""

    def run(batch: pa.RecordBatch, sets: list) -> pa.RecordBatch:
        first = [x[: least_shared(len(x), similarity)[0]] for x in sets]
        return _dealt(batch.column("node").to_pylist(), first, buckets)

    return _packed(run, points.select("node", "shingles"), DEALT)


def shared(dealt: DataFrame) -> DataFrame:
    """node, met: how many of its first shingles another one has among its own.

    32 bits tell the shingles of a bucket apart; two that are taken for one only add to ``met``.
    """

    def count(table: pa.Table) -> pa.Table:
        nodes = np.frombuffer(b"".join(table.column("nodes").to_pylist()), "<i8")
        parts = np.frombuffer(b"".join(table.column("parts").to_pylist()), "<u4")
        order = np.lexsort((nodes, parts))
        nodes, parts = nodes[order], parts[order]
        new = np.ones(len(nodes), bool)  # rows may repeat
        new[1:] = (np.diff(parts) != 0) | (np.diff(nodes) != 0)
        nodes, parts = nodes[new], parts[new]
        same = np.zeros(len(nodes) + 1, bool)
        same[1:-1] = parts[1:] == parts[:-1]
        found, n = np.unique(nodes[same[1:] | same[:-1]], return_counts=True)
        return pa.table({"node": found, "met": n.astype(np.int64)})

    counted = dealt.groupBy("bucket").applyInArrow(count, "node long, met long")
    return counted.groupBy("node").agg(F.sum("met").alias("met"))


def may_have_links(similarity: int) -> Column:
    """Whether a point shares as many of its first shingles as with its smallest partner."""
    smallest = F.ceil(F.col("n") * similarity / 100)
    return F.col("met") >= F.greatest(F.lit(1), F.floor(smallest / 10))


def points_of(texts: DataFrame, width: int) -> DataFrame:
    """node, n, met and the packed sorted shingles of texts with the set of their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(3).to_pylist()
            hit, packed = [], []
            for key, points in zip(keys, shingle_sets(batch.column(4), width), strict=True):
                hit.append(key_of(points) == key)  # another row of that id may have another text
                if hit[-1]:
                    packed.append(points.tobytes())
            mask = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).filter(mask) for k in range(3)), pa.array(packed, pa.binary())],
                ["node", "n", "met", "shingles"],
            )

    read = texts.select("node", "n", "met", "set_key", "text")
    return read.mapInArrow(run, "node long, n long, met long, shingles binary")


def _packed(function, points: DataFrame, schema: str) -> DataFrame:
    """``function(rows of node, n, shingle array)`` of every batch of ``points``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch, [np.frombuffer(x, U64) for x in batch.column("shingles").to_pylist()])

    # columns of their own, as the same points are joined with the result
    return points.select(*[F.col(c).alias(c) for c in points.columns]).mapInArrow(run, schema)


def elected(points: DataFrame, round_: int) -> DataFrame:
    """node of the pivots of a round.

    In each election, of the points with the same least shingle (each election and round ranks
    shingles anew) the one that shares most goes on. Similar points mostly have the same one,
    so a group of near copies gets few pivots, and a point without such company is one itself.
    Later rounds elect less strictly, so that dense groups end too.
    """
    elections = max(1, ELECTIONS - round_)
    several = 8 ** max(0, round_ - ELECTIONS + 1)
    salts = [mix(np.array([1000 * round_ + e + 1], U64))[0] for e in range(elections)]

    def least(batch: pa.RecordBatch, sets: list) -> pa.RecordBatch:
        ranks = [[int(mix(x ^ s).min().view(np.int64)) for x in sets] for s in salts]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("node"),
                batch.column("met"),
                *(pa.array(r, pa.int64()) for r in ranks),
            ],
            ["node", "met", *(f"least_{e}" for e in range(elections))],
        )

    names = [f"least_{e}" for e in range(elections)]
    schema = "node long, met long, " + ", ".join(f"{n} long" for n in names)
    left = _packed(least, points.select("node", "met", "shingles"), schema)
    for e, name in enumerate(names):
        best = F.min(F.struct((-F.col("met")).alias("order"), "node", *names[e + 1 :])).alias("best")
        group = F.pmod(F.xxhash64("node"), F.lit(several))
        left = left.groupBy(name, group.alias("part")).agg(best).select(
            "best.node", (-F.col("best.order")).alias("met"), *[f"best.{n}" for n in names[e + 1 :]]
        )
    return left.select("node")


def frequent(points: DataFrame, round_: int) -> np.ndarray:
    """The most frequent shingles, the rarer ones first, told from every ``COUNTED``-th point of
    the first round, and from all of the few that later ones have.

    They only say in which order shingles are taken; any order finds the same pairs.
    """
    every = max(1, COUNTED >> (2 * round_))

    def tokens(batch: pa.RecordBatch, sets: list) -> pa.RecordBatch:
        chosen = mix(batch.column("node").to_numpy(zero_copy_only=False).astype(U64)) % U64(every) == 0
        flat = np.concatenate([np.zeros(0, U64), *(x for x, c in zip(sets, chosen, strict=True) if c)])
        found, n = np.unique(flat, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["token", "times"])

    counts = _packed(tokens, points.select("node", "shingles"), "token long, times long")
    counts = counts.groupBy("token").agg(F.sum("times").alias("times")).where("times > 2")
    most = counts.orderBy(F.desc("times"), "token").limit(FREQUENT).collect()
    return np.array([r.token for r in reversed(most)], np.int64).view(U64)


def meetings(points: DataFrame, pivots: DataFrame, reach: int, last: np.ndarray) -> DataFrame:
    """node, pivot, n, m, rest: a row for every first shingle that a point and a pivot share.

    Shingles come in the order of their hash, those of ``last`` after all others. A passage that
    many points have is thus among the first shingles of few, and pairs meet by what is rarer.
    """
    sorted_, rank = np.sort(last), np.argsort(last)

    def listed(batch: pa.RecordBatch, sets: list) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in sets], np.int64)
        lengths = sizes - -(-reach * sizes // 100) + 1  # any two in reach share one of these
        flat = np.concatenate([np.zeros(0, U64), *sets])
        place = (flat >> U64(2)).astype(np.int64)
        if len(sorted_):
            at = np.minimum(np.searchsorted(sorted_, flat), len(sorted_) - 1)
            late = sorted_[at] == flat
            place[late] = (1 << 62) + rank[at[late]]
        starts = np.cumsum(sizes) - sizes
        order = np.lexsort((flat, place, np.repeat(np.arange(len(sets)), sizes)))
        inside = np.arange(len(flat)) - np.repeat(starts, sizes) < np.repeat(lengths, sizes)
        kept = order[inside]
        repeat = lambda values: pa.array(np.repeat(np.asarray(values, np.int64), lengths))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(flat[kept].view(np.int64)),
                repeat(batch.column("node").to_numpy(zero_copy_only=False)),
                repeat(batch.column("n").to_numpy(zero_copy_only=False)),
                repeat(sizes - lengths),
                repeat(place[kept][np.cumsum(lengths) - 1] if len(sets) else []),
            ],
            ["token", "node", "n", "rest", "last"],
        )

    schema = "token long, node long, n long, rest long, last long"
    own = _packed(listed, points.select("node", "n", "shingles"), schema)
    other = _packed(listed, pivots, schema).select(
        "token", *(F.col(c).alias(o) for c, o in (("node", "pivot"), ("n", "m"), ("rest", "p_rest"), ("last", "p_last")))
    )
    alike = F.least("n", "m") * 100 >= F.greatest("n", "m") * reach
    rest = "CASE WHEN last < p_last THEN rest WHEN last > p_last THEN p_rest ELSE greatest(rest, p_rest) END"
    met = own.join(other, "token").where((F.col("node") != F.col("pivot")) & alike)
    return met.select("node", "pivot", "n", "m", F.expr(rest).alias("rest"))


def in_reach(points: DataFrame, pivots: DataFrame, reach: int, round_: int) -> DataFrame:
    """Points of at least ``reach`` similarity to a pivot: node, pivot, n, m, both, and the
    shingles that one of the two has alone.

    Both have node, n and shingles. Pairs meet through their first shingles. Of the pair, the
    set whose first shingles end earlier has ``rest`` others; as the shingles are in one order,
    no more than these can be shared besides the ones that met. Pairs for which that is enough
    are measured on full sets.
    """
    met = (
        meetings(points, pivots, reach, frequent(points, round_))
        .groupBy("node", "pivot")
        .agg(F.count("*").alias("met"), *(F.max(c).alias(c) for c in ("n", "m", "rest")))
        .where(f"(met + rest) * {100 + reach} >= {reach} * (n + m)")
        .select("node", "pivot")
    )
    sides = met.join(points.select("node", "n", "shingles"), "node").join(
        pivots.select(
            F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("shingles").alias("others")
        ),
        "pivot",
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, apart, near = [], [], []
            for x, y in zip(*(batch.column(c).to_pylist() for c in ("shingles", "others")), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                one = np.setxor1d(x, y, assume_unique=True)
                shared_ = (len(x) + len(y) - len(one)) // 2
                near.append(100 * shared_ >= reach * (shared_ + len(one)))
                if near[-1]:
                    both.append(shared_)
                    apart.append(one.tobytes())
            mask = pa.array(near, pa.bool_())
            arrays = [batch.column(c).filter(mask) for c in ("node", "pivot", "n", "m")]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(both, pa.int64()), pa.array(apart, pa.binary())],
                ["node", "pivot", "n", "m", "both", "apart"],
            )

    columns = ("node", "pivot", "n", "m", "shingles", "others")
    return sides.select(*[F.col(c).alias(c) for c in columns]).mapInArrow(
        measure, "node long, pivot long, n long, m long, both long, apart binary"
    )


def at_least(similarity: int) -> Column:
    return F.expr(f"100 * both >= {similarity} * (n + m - both)")


def window_links(near: DataFrame, labels: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) of points inside a region to points in reach of its pivot.

    Both differ little from the pivot, and |x ^ y| = |x ^ p| + |y ^ p| - 2 |(x ^ p) & (y ^ p)|.
    Points linked with the pivot are one component already, and are compared with others only.
    Of the links of a point to one component, one is enough. A large region is cut into tiles,
    and every two of them meet in a cell of their own.
    """
    label = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    told = (
        near.withColumn("d", F.expr("1D - both / (n + m - both)"))
        .join(label("node"), "node", "left")
        .join(label("pivot"), "pivot", "left")
        .withColumn("component", F.coalesce("node_in", "node"))
        .withColumn("joined", (F.col("component") == F.coalesce("pivot_in", "pivot")).cast("int"))
        .select("node", "pivot", "n", "d", "apart", "component", "joined", "at_home")
    )
    told = stored(told)
    nearest = (
        told.where("at_home")
        .groupBy("node")
        .agg(F.min(F.struct("d", "pivot")).alias("best"))
        .select("node", "best.pivot", F.lit(1).alias("inside"))
    )
    told = told.drop("at_home").join(nearest, ["node", "pivot"], "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    count = lambda side, joined: F.ceil(
        F.sum(F.when(F.col("joined") == joined, F.col("inside") if side == "a" else F.lit(1)).otherwise(0)) / TILE
    ).alias(f"{side}{joined}")
    sizes = told.groupBy("pivot").agg(*(count(s, j) for s in "ab" for j in (0, 1))).where("b0 > 0 AND a0 + a1 > 0")
    tiles = lambda side, joined, when="true": (
        f"IF({side}{joined} > 0 AND {when}, transform(sequence(0L, {side}{joined} - 1),"
        f" t -> struct({joined} AS other, t AS other_tile)), array())"
    )
    cells = []
    for side, other, rows in (("a", "b", told.where("inside = 1")), ("b", "a", told)):
        own = F.expr(f"pmod(xxhash64(node), greatest(IF(joined = 1, {side}1, {side}0), 1))")
        # two points that are joined with the pivot are not compared
        met = F.expr(f"concat({tiles(other, 0)}, {tiles(other, 1, 'joined = 0')})")
        dealt = rows.join(sizes, "pivot").select(
            "pivot", "node", "n", "d", "apart", "component", F.col("joined").alias(f"{side}_joined"),
            own.alias(f"{side}_tile"), F.explode(met).alias("met"),
        )
        dealt = dealt.withColumns({f"{other}_joined": F.col("met.other"), f"{other}_tile": F.col("met.other_tile")}).drop("met")
        cells.append(dealt.select(*[F.col(c).alias(c) for c in dealt.columns]))
    radius = (100 - similarity) / 100 + 1e-9  # a little more for rounding

    def compare(inside: pa.Table, outside: pa.Table) -> pa.Table:
        found = {"a": [], "b": []}
        if inside.num_rows and outside.num_rows:
            inside = inside.sort_by("d")
            sets = [np.frombuffer(x, U64) for x in inside.column("apart").to_pylist()]
            alone = np.array([len(x) for x in sets])
            owner = np.repeat(np.arange(len(sets)), alone)
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            nodes, sizes_, d, component = (inside.column(c).to_numpy() for c in ("node", "n", "d", "component"))
            columns = (outside.column(c).to_pylist() for c in ("node", "n", "d", "component", "apart"))
            for node, n, distance, group, packed in zip(*columns, strict=True):
                first, last = np.searchsorted(d, distance - radius), np.searchsorted(d, distance + radius, "right")
                own = np.frombuffer(packed, U64)
                low, high = (np.searchsorted(flat, own, s) for s in ("left", "right"))
                lengths = high - low
                ends = np.cumsum(lengths)
                at = np.arange(lengths.sum()) + np.repeat(low - ends + lengths, lengths)
                common = np.bincount(owner[at], minlength=len(sets))[first:last]
                whole = n + sizes_[first:last]
                both = (whole - alone[first:last] - len(own) + 2 * common) // 2
                hit = (100 * both >= similarity * (whole - both)) & (component[first:last] != group)
                if hit.any():
                    _, one = np.unique(component[first:last][hit], return_index=True)
                    linked = nodes[first:last][hit][one].tolist()
                    found["a"] += [node] * len(linked)
                    found["b"] += linked
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()})

    keys = ["pivot", "a_joined", "a_tile", "b_joined", "b_tile"]
    return cells[0].groupBy(*keys).cogroup(cells[1].groupBy(*keys)).applyInArrow(compare, "a long, b long")


def similar_documents(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    similarity: int = SIMILARITY,
) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id.

    Documents are linked if 100 * shared shingles >= similarity * all their shingles; a
    component is what links reach, named by its smallest id. Regions reach twice and windows
    three times as far as links, or once and twice in later rounds and below a similarity of 75,
    which is over 50.
    All links between different sets are covered, but of those to one component one is made.

    Texts without words (NULL, empty) have no shingles and are linked with nothing. Rows of
    equal sets are one point, whatever their ids. A row with a NULL id joins the component of
    equal sets, else its component is NULL. An empty table gives no rows; only the two columns
    are read. A text's set is held whole in a task, 8 bytes a shingle.
    """
    if not 50 < similarity <= 100:
        raise ValueError("similarity must be over 50 and at most 100")
    rows = stored(signed(df, id_column, text_column, width))
    nodes = stored(
        rows.where("set_key IS NOT NULL AND id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("id").alias("least_id"), F.first("n_shingles").alias("n"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    shingles = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, shingles // BUCKET)
    met = shared(dealt_texts(df, text_column, width, similarity, buckets))
    owner = F.conv(F.hex(F.substring("set_key", 1, 8)), 16, -10).cast("long")
    kept = (
        nodes.withColumn("owner", owner)
        .join(met.withColumnRenamed("node", "owner"), "owner")
        .where(may_have_links(similarity))
        .drop("owner")
    )
    texts = df.select(F.col(id_column).cast("long").alias("least_id"), F.col(text_column).cast("string").alias("text"))
    texts = kept.join(texts, "least_id").withColumn("content", F.xxhash64("text"))
    # rows that repeat id and text, where the join has brought them together
    texts = texts.dropDuplicates(["least_id", "node", "content"])
    left = stored(points_of(texts, width))
    near = None
    for round_ in range(1 << 30):
        if left.isEmpty():
            break
        times = 2 if similarity >= 75 and round_ < WIDE else 1
        home, reach = (max(1, 100 - k * (100 - similarity)) for k in (times, times + 1))
        chosen = elected(left, round_)
        pivots = stored(left.select("node", "n", "shingles").join(chosen, "node", "left_semi"))
        found = stored(in_reach(left, pivots, reach, round_).withColumn("at_home", at_least(home)))
        near = found if near is None else near.union(found)
        gone = found.where("at_home").select("node").union(pivots.select("node"))
        rest = left.drop("met").join(gone.distinct(), "node", "left_anti")
        met = shared(dealt_points(rest, similarity, buckets))
        left = stored(rest.join(met, "node").where(may_have_links(similarity)))
    if near is None:
        labels = nodes.select("node", F.col("node").alias("component")).limit(0)
    else:
        links = near.where(at_least(similarity))
        labels = stored(components(links.select(F.col("node").alias("a"), F.col("pivot").alias("b"))))
        more = stored(window_links(near, labels, similarity))
        if not more.isEmpty():
            stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
            labels = components(stars.union(more))
    of_node = nodes.select("set_key", "node", "least_id").join(labels, "node", "left").select(
        "set_key", "least_id", F.coalesce("component", "node").alias("component")
    )
    least = of_node.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = of_node.join(least, "component").select("set_key", "component_id")
    return rows.select("id", "n_shingles", "set_key").join(named, "set_key", "left").select(
        F.col("id").alias(id_column), "n_shingles", F.coalesce("component_id", "id").alias("component_id")
    )
