"""Near duplicates: signatures as inverted lists of (coordinate, value)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .names import free_names
from .words import U64, blocks, hash_words, text_bytes

WIDTH = 3
#: Least similarity of linked documents, in hundredths.
SIMILARITY = 85
#: Coordinates of a signature, and how many must agree. Of two sets with the least similarity
#: fewer than 15 of 32 agree once in 10 million.
COORDINATES, MATCHES = 32, 15
#: Members of a list that are paired with one another in one place.
TILE = 1024
#: Classes of shingles by which unlike documents are told.
CLASSES = 64
#: Shingles of a bucket in which those of a single document are counted.
BUCKET_SHINGLES = 1 << 20

_random = np.random.default_rng(7)
FACTORS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
TERMS = _random.integers(1, 1 << 63, 64, dtype=np.uint64)

SIGNATURE = "id long, n_shingles long, set_key binary, tokens array<long>, profile array<int>"


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of texts: sorted distinct shingle hashes, and the first of each text."""
    data, offsets = text_bytes(column)
    for first, last in blocks(offsets):
        base = offsets[first]
        part = hash_words(data[base : offsets[last]], offsets[first : last + 1] - base)
        found, starts = part.shingles(width)
        sets = [np.unique(found[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
        flat = np.concatenate(sets) if sets else np.zeros(0, U64)
        yield flat, np.concatenate(([0], np.cumsum(sizes)))


def minima(flat: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """A row for each non-empty set: coordinate in the high half, least value in the low."""
    full = starts[:-1][np.diff(starts) > 0]
    out = np.empty((len(full), coordinates), np.int64)
    for j in range(coordinates if len(full) else 0):
        values = (flat * FACTORS[j] + TERMS[j]) >> U64(32)
        out[:, j] = np.minimum.reduceat(values, full).astype(np.int64) | (j << 32)
    return out


def signatures(
    df: DataFrame, id_column: str, text_column: str, width: int, coordinates: int
) -> DataFrame:
    """id, n_shingles, set_key (128 bits of the set), tokens and profile of every row.

    The profile is how many shingles fall into each of ``CLASSES`` classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for flat, starts in shingle_sets(batch.column(1), width):
                sizes = np.diff(starts)
                keys = [
                    hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() if a < b else None
                    for a, b in zip(starts[:-1], starts[1:], strict=True)
                ]
                rows = minima(flat, starts, coordinates)
                ends = np.concatenate(([0], np.cumsum(sizes > 0))) * coordinates
                tokens = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(rows.reshape(-1))
                )
                owner = np.repeat(np.arange(len(sizes)), sizes) * CLASSES
                place = owner + (flat % U64(CLASSES)).astype(np.int64)
                counts = np.bincount(place, minlength=len(sizes) * CLASSES).astype(np.int32)
                profile = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(sizes) + 1) * CLASSES, pa.int32()), pa.array(counts)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sizes)),
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.binary()),
                        tokens,
                        profile,
                    ],
                    ["id", "n_shingles", "set_key", "tokens", "profile"],
                )
                at += len(sizes)

    read = df.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")
    )
    return read.mapInArrow(run, SIGNATURE)


def postings(sets: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """The tokens under which each node is posted: node, posted.

    Two sets that agree in ``matches`` coordinates share a token even if each is posted only
    under its ``coordinates - matches + 1`` shortest lists: the longest lists are skipped.
    Tokens of a single set need no list but count as the shortest.
    """
    tokens = sets.select("node", F.explode("tokens").alias("token"))
    lengths = tokens.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
    # at most ``coordinates`` tokens for a node
    listed = tokens.join(lengths, "token").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("length", "token"))).alias("lists")
    )
    alone = coordinates - F.size("lists")
    wanted = F.greatest(coordinates - matches + 1 - alone, F.lit(0))
    shortest = F.transform(F.slice("lists", F.lit(1), wanted), lambda x: x["token"])
    return listed.select("node", shortest.alias("posted")).where(F.size("posted") > 0)


LONE = "node long, lone long"


def lone_shingles(texts: DataFrame, shingles: int, width: int) -> DataFrame:
    """How many shingles of each node no other node has: node, lone.

    32 bits of a shingle tell it apart from others of its bucket; two that are taken for one
    only make the count too small.
    """
    buckets = max(1, shingles // BUCKET_SHINGLES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            at = 0
            for flat, starts in shingle_sets(batch.column(1), width):
                owner = np.repeat(nodes[at : at + len(starts) - 1], np.diff(starts))
                at += len(starts) - 1
                bucket = (flat % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                found, cuts = np.unique(bucket[order], return_index=True)
                part = (flat[order] >> U64(32)).astype("<u4")
                packed = [
                    [x.tobytes() for x in np.split(values, cuts[1:])] if len(found) else []
                    for values in (owner[order], part)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), *(pa.array(p, pa.binary()) for p in packed)],
                    ["bucket", "nodes", "parts"],
                )

    def count(table: pa.Table) -> pa.Table:
        nodes = np.frombuffer(b"".join(table.column("nodes").to_pylist()), np.int64)
        parts = np.frombuffer(b"".join(table.column("parts").to_pylist()), "<u4")
        order = np.argsort(parts, kind="stable")
        sorted_parts = parts[order]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = sorted_parts[1:] == sorted_parts[:-1]
        found, n = np.unique(nodes[order[~(same[1:] | same[:-1])]], return_counts=True)
        return pa.table({"node": found, "lone": n.astype(np.int64)})

    dealt = texts.select("node", "text").mapInArrow(deal, "bucket long, nodes binary, parts binary")
    counted = dealt.groupBy("bucket").applyInArrow(count, LONE)
    return counted.groupBy("node").agg(F.sum("lone").alias("lone"))


def may_link(similarity: int) -> Column:
    """Whether sizes and lone shingles of a and b allow the similarity.

    Lone shingles of one are not in the other: so the shared ones are no more than either has
    besides them, and all together are at least the one's shingles and the other's lone ones.
    """
    shared = F.least(F.expr("n_a - lone_a"), F.expr("n_b - lone_b"))
    whole = F.greatest(F.expr("n_a + lone_b"), F.expr("n_b + lone_a"))
    return shared * 100 >= whole * similarity


def agree(matches: int) -> Column:
    """Whether the whole signatures of a and b agree enough."""
    return F.size(F.array_intersect("tokens_a", "tokens_b")) >= matches


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """Pairs whose full shingle sets are similar enough, with their other columns."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                a, b = (
                    [
                        flat[x:y]
                        for flat, starts in shingle_sets(part.column(k), width)
                        for x, y in zip(starts[:-1], starts[1:], strict=True)
                    ]
                    for k in ("text_a", "text_b")
                )
                for x, y in zip(a, b, strict=True):
                    both = np.intersect1d(x, y, assume_unique=True).size
                    hit.append(100 * both >= similarity * (x.size + y.size - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(hit, pa.bool_())) for c in names], names
            )

    side = lambda c: texts.select(
        F.col("node").alias(c), F.col("text").alias(f"text_{c}")
    )
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.select(*names, "text_a", "text_b").mapInArrow(run, pairs.schema)


def profiles_allow(similarity: int) -> Column:
    """Whether the profiles of a and b allow the similarity: of each class they share no more
    shingles than either has."""
    smaller = F.zip_with("profile_a", "profile_b", lambda x, y: F.least(x, y).cast("long"))
    shared = F.aggregate(smaller, F.lit(0).cast("long"), lambda total, x: total + x)
    return shared * 100 >= (F.expr("n_a + n_b") - shared) * similarity


def _padded(rows: list[list[int]]) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), -1, np.int64)
    for line, row in zip(out, rows, strict=True):
        line[: len(row)] = row
    return out


def _matrix(table: pa.Table, name: str, kind) -> np.ndarray:
    flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(table.num_rows, -1)


def cross_pairs(members: DataFrame, similarity: int, matches: int) -> DataFrame:
    """Pairs of one list that are in different components and may be similar: a, b and their
    components.

    A long list is cut into tiles, and each pair of tiles is compared in its own place, whole
    rows of signatures and profiles at a time. A pair is given by the first list that has both.
    """
    tiles = F.ceil(F.col("length") / TILE).cast("long")
    dealt = members.withColumns(
        {"tiles": tiles, "tile": F.pmod(F.xxhash64("node"), F.greatest(tiles, F.lit(1)))}
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    keys = ["token", "row", "col"]
    cells = []
    for own, other in (("row", "col"), ("col", "row")):
        side = dealt.withColumn("other", every).select(
            "token",
            F.col("tile").alias(own),
            F.col("other").alias(other),
            *("node", "n_shingles", "lone", "profile", "tokens", "posted", "component"),
        )
        side = side.where("row <= col")  # either order of two tiles
        cells.append(side.select(*[F.col(c).alias(c) for c in side.columns]).groupBy(*keys))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ("a", "b", "component_a", "component_b")
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
        if a.num_rows and b.num_rows:
            node_b, n_b, lone_b, in_b = (b.column(c).to_numpy() for c in ("node", "n_shingles", "lone", "component"))
            tokens_b, profile_b = _matrix(b, "tokens", np.int64), _matrix(b, "profile", np.int32)
            tokens_a, profile_a = _matrix(a, "tokens", np.int64), _matrix(a, "profile", np.int32)
            posted_a, posted_b = a.column("posted").to_pylist(), _padded(b.column("posted").to_pylist())
            token, alike = a.column("token")[0].as_py(), a.column("row")[0].as_py() == a.column("col")[0].as_py()
            rows = zip(*(a.column(c).to_pylist() for c in ("node", "n_shingles", "lone", "component")), strict=True)
            for i, (node, n, lone, group) in enumerate(rows):
                # lone shingles of one are not in the other (see ``may_link``)
                shared = np.minimum(n - lone, n_b - lone_b)
                whole = np.maximum(n + lone_b, n_b + lone)
                other = node_b > node if alike else node_b != node
                some = np.flatnonzero((in_b != group) & other & (100 * shared >= similarity * whole))
                some = some[(tokens_b[some] == tokens_a[i]).sum(axis=1) >= matches]
                shared = np.minimum(profile_b[some], profile_a[i]).sum(axis=1, dtype=np.int64)
                some = some[100 * shared >= similarity * (n + n_b[some] - shared)]
                before = [t for t in posted_a[i] if t < token]
                some = some[~np.isin(posted_b[some], before).any(axis=1)]
                if len(some):
                    first = node < node_b[some]
                    own = (np.full(len(some), node), np.full(len(some), group))
                    found[0].append(np.where(first, own[0], node_b[some]))
                    found[1].append(np.where(first, node_b[some], own[0]))
                    found[2].append(np.where(first, own[1], in_b[some]))
                    found[3].append(np.where(first, in_b[some], own[1]))
        return pa.table({c: np.concatenate(x) for c, x in zip(names, found, strict=True)})

    schema = "a long, b long, component_a long, component_b long"
    return cells[0].cogroup(cells[1]).applyInArrow(compare, schema).distinct()


def near_duplicates(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    similarity: int = SIMILARITY,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id, kept.

    Documents are linked if 100 * shared shingles >= similarity * all their shingles, checked
    on the full sets; a component is what links reach, named by its smallest id, which is
    kept. Equal sets are one node. First every list pairs its members with the one that has
    fewest shingles of its own; then only members of one list that are still in different
    components are paired, so a group of near copies takes about as many pairs as it has
    members, and no link between components is left out. Most pairs are told to be too
    unlike, before they are formed, by the shingles that one document has alone and by the
    numbers of shingles in classes.

    Texts without words (NULL, empty) have no shingles and are linked with nothing. Rows with
    the same id count as linked. A row with a NULL id joins the component of equal sets, else
    its component is NULL and it is kept. An empty table gives no rows; only the two columns
    are read. The set of a text of any length is held whole in a task, 8 bytes a shingle.
    """
    signed = stored(signatures(df, id_column, text_column, width, coordinates))
    sets = stored(
        signed.where("set_key IS NOT NULL AND id IS NOT NULL")
        .groupBy("set_key")
        .agg(
            F.min("id").alias("node"),
            *(F.first(c).alias(c) for c in ("n_shingles", "tokens", "profile")),
        )
    )
    met = stored(sets.drop("set_key").join(postings(sets, coordinates, matches), "node"))
    texts = stored(
        df.select(F.col(id_column).cast("long").alias("node"), F.col(text_column).alias("text"))
        .join(met.select("node"), "node", "left_semi")
    )
    shingles = met.agg(F.sum("n_shingles")).first()[0] or 0
    lone = F.coalesce("lone", F.lit(0))
    members = (
        met.join(lone_shingles(texts, shingles, width), "node", "left")
        .withColumn("lone", lone)
        .where((F.col("n_shingles") - F.col("lone")) * 100 >= F.col("n_shingles") * similarity)
    )
    members = stored(members).withColumn("token", F.explode("posted"))
    # the member with fewest shingles of its own is most like the others
    described = F.struct("lone", "node", "n_shingles", "profile", "tokens")
    lengths = members.groupBy("token").agg(
        F.count("*").alias("length"), F.min(described).alias("centre")
    )
    lists = stored(members.join(lengths.where("length > 1"), "token"))
    of_centre = {"b": "node", "n_b": "n_shingles", "lone_b": "lone", "tokens_b": "tokens", "profile_b": "profile"}
    by_centre = (
        lists.where("node <> centre.node")
        .withColumnsRenamed(
            {"node": "a", "n_shingles": "n_a", "lone": "lone_a", "tokens": "tokens_a", "profile": "profile_a"}
        )
        .withColumns({new: F.col(f"centre.{old}") for new, old in of_centre.items()})
        .where(may_link(similarity) & profiles_allow(similarity) & agree(matches))
        .select("a", "b")
        .distinct()
    )
    first = stored(components(confirmed(by_centre, texts, width, similarity)))
    labelled = lists.where("node <> centre.node").join(first, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    split = (
        labelled.groupBy("token")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("token")
    )
    candidates = cross_pairs(labelled.join(split, "token"), similarity, matches)
    more = confirmed(candidates, texts, width, similarity)
    # components of what the first round has found, joined by the new links
    second = components(more.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")))
    second = second.select(F.col("node").alias("found_first"), F.col("component").alias("found_then"))
    named = (
        sets.select("set_key", "node")
        .join(first, "node", "left")
        .select("set_key", F.coalesce("component", "node").alias("found_first"))
        .join(second, "found_first", "left")
        .select("set_key", F.coalesce("found_then", "found_first").alias("found"))
    )
    found = signed.select("id", "n_shingles", "set_key").join(named, "set_key", "left")
    return found.select(
        F.col("id").alias(id_column),
        "n_shingles",
        F.coalesce("found", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("found", "id")).alias("kept"),
    )


def one_of_each(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The rows of ``df`` that are kept, one per component, with all their columns.

    Rows that share a kept id are one document; the first by text stays. Rows with a NULL id
    all stay.
    """
    kept_id, place = free_names(df, "kept_id", "place")
    kept = near_duplicates(df, id_column, text_column, **how).where("kept")
    met = df.join(
        kept.select(F.col(id_column).alias(kept_id)).distinct(),
        F.col(id_column).cast("long") == F.col(kept_id),
        "left_semi",
    )
    order = Window.partitionBy(F.col(id_column).cast("long")).orderBy(F.col(text_column))
    first = met.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return first.unionByName(df.where(F.col(id_column).isNull()))
