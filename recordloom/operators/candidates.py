"""Matches without all pairs: candidates from equality joins, every one verified.

The first three rules need similar first names, similar last names and equal birth dates;
the fourth needs last names at most two edits apart. Which names are similar is found
among the distinct names of a block, and everything else is an equality join. A pair that
is never formed is known to be ``No Match``. Records that agree in everything the rules
look at are first folded into one profile, so a group of copies of any size costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text, vectors
from ..functions.vectors import Embedder
from ..schemas import RECORD_VECTORS
from ..session import durable, shuffle_width
from . import rules
from .cosine import near_vectors
from .pairs import TILE_ROWS, Measure, block_sizes, known, measure, pairs_among, self_pairs

# Two texts at most two edits apart always share a key of `edit_keys`.
_MAX_EDITS = 2
_SHORT = 16
# About what a last name makes; only used to judge how far to spread the names.
_KEYS_PER_NAME = 60


def _deletion_keys(s: str) -> str:
    """What is left of the text without up to two of its characters, as a SQL array."""
    one = f"transform(sequence(1, greatest(length({s}), 1)), i -> concat(left({s}, i - 1), substr({s}, i + 1)))"
    two = (
        f"flatten(transform(sequence(1, greatest(length({s}) - 1, 1)), i ->"
        f" transform(sequence(i, greatest(length({s}) - 1, 1)), j ->"
        f" concat(left({s}, i - 1), substr({s}, i + 1, j - i), substr({s}, j + 2)))))"
    )
    return f"concat(array({s}), {one}, {two})"


def _segment_keys(s: str) -> str:
    """Three even segments of the text, and where they can lie in a longer neighbour.

    Two edits cannot touch all three segments of the shorter text, so one of them is found
    unchanged in the longer text, shifted by at most two. For every length ``n`` the
    shorter text may have, segment ``k`` takes ``n div 3`` characters, the last ``n % 3``
    segments one more.
    """
    start = "n div 3 * k + greatest(k - 3 + n % 3, 0) + shift"
    size = "n div 3 + int(k >= 3 - n % 3)"
    piece = (
        f"if({start} >= 0 AND {start} + {size} <= length({s}),"
        f" concat_ws(':', 's', k, n, substr({s}, int({start} + 1), int({size}))), NULL)"
    )
    edits = _MAX_EDITS
    return (
        f"array_compact(flatten(transform(sequence(length({s}) - {edits}, length({s})),"
        f" n -> flatten(transform(sequence(0, 2), k ->"
        f" transform(sequence(-{edits}, {edits}), shift -> {piece}))))))"
    )


def edit_keys(column: str) -> Column:
    """Keys such that texts at most two edits apart have one in common.

    Short texts are keyed by what remains after up to two deletions, long ones by
    segments; lengths near the border get both, so either pair of lengths meets. Keys are
    hashed: equal hashes of different keys only add a pair to verify.
    """
    return F.expr(
        f"array_distinct(transform(concat(if(length({column}) <= {_SHORT + _MAX_EDITS}, {_deletion_keys(column)}, array()),"
        f" if(length({column}) > {_SHORT}, {_segment_keys(column)}, array())), key -> xxhash64(key)))"
    )


def near_names(
    names: DataFrame,
    block: Sequence[str],
    column: str = "lastname",
    bound: Measure | None = None,
) -> DataFrame:
    """Ordered pairs ``(<column>_a <= <column>_b)`` of distinct texts within two edits."""
    distinct = names.select(*block, column).filter(F.col(column).isNotNull()).distinct()
    # Spread by hand: a name of few bytes makes many keys.
    width = shuffle_width(names, bound and bound.total * _KEYS_PER_NAME)
    spread = distinct.repartition(width, F.xxhash64(*block, column))
    keyed = spread.withColumn("__key", F.explode(edit_keys(column)))
    if bound is None or bound.largest > TILE_ROWS:
        keyed = durable(keyed)  # measured and joined
    pairs = self_pairs(
        keyed, [*block, "__key"], column, F.col(f"a.{column}") < F.col(f"b.{column}"), bound=bound
    ).select(
        *[F.col(f"a.{c}").alias(c) for c in block],
        *[F.col(f"{side}.{column}").alias(f"{column}_{side}") for side in "ab"],
    )
    near = text.within_edits(f"{column}_a", f"{column}_b", _MAX_EDITS)
    itself = distinct.select(
        *block, *[F.col(column).alias(f"{column}_{side}") for side in "ab"]
    )
    return itself.unionByName(pairs.filter(near).distinct())


def profiles(records: DataFrame, block: Sequence[str]) -> DataFrame:
    """Records that no rule can tell apart, as one row with their number."""
    return (
        records.withColumns(
            {"dob": text.known_dob("dob"), "gender": text.known_gender("gender")}
        )
        .groupBy(*block, *RECORD_VECTORS, "dob", "gender")
        .agg(F.count("*").alias("copies"), F.min("id").alias("id"))
    )


STRONG = (rules.EXACT, rules.HIGH, rules.ADDRESS)


_VECTOR_KEYS = {c: f"__{c}_key" for c in RECORD_VECTORS}
#: Cosines of the same vectors, summed in another order, differ by less.
_MARGIN = 1e-6


def with_vector_keys(records: DataFrame) -> DataFrame:
    """Add 128 bits of each vector by which equal vectors are known; NULL for a NULL."""
    return records.withColumns(
        {
            key: F.when(
                F.col(vector).isNotNull(),
                F.concat_ws(".", F.xxhash64(vector), F.xxhash64(F.lit(1), F.col(vector))),
            )
            for vector, key in zip(RECORD_VECTORS.values(), _VECTOR_KEYS.values())
        }
    )


def similar_texts(
    rows: DataFrame,
    block: Sequence[str],
    column: str,
    score: str,
    above: float,
    embed: Embedder | None = None,
    bound: Measure | None = None,
) -> DataFrame:
    """``<column>_a, <column>_b, score`` for the distinct texts of a block, both ways round.

    Holds every text with itself, and two texts whose vectors' cosine lies above the limit.
    The vectors are made here, once per distinct text. Without ``embed`` they are the rows' own,
    and keys of vectors (see ``with_vector_keys``) take the place of texts.
    """
    vector = RECORD_VECTORS[column]
    if embed is None:
        column = _VECTOR_KEYS[column]
    rows = rows.filter(F.col(column).isNotNull())
    if embed is None:
        texts = rows.groupBy(*block, column).agg(F.any_value(vector).alias(vector))
    else:
        texts = embed(rows.select(*block, column).distinct(), {column: vector})
    near = near_vectors(texts, block, column, vector, score, above)
    a, b = F.col(f"{column}_a"), F.col(f"{column}_b")
    turned = F.inline(
        F.array(F.struct(a, b, score), F.struct(b.alias(f"{column}_a"), a.alias(f"{column}_b"), score))
    )
    own = F.when(vectors.vector_norm(vector) > 0, F.lit(1.0))
    same = texts.select(
        *block, F.col(column).alias(f"{column}_a"), F.col(column).alias(f"{column}_b"), own.alias(score)
    )
    return same.unionByName(near.select(*block, turned))


def _similar_name_pairs(
    rows: DataFrame,
    block,
    limits,
    embed: Embedder | None = None,
    condition: Column | None = None,
    bound: Measure | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Labelled pairs of equal birth date and similar names.

    They include every pair that one of the first three rules takes, if vectors are made by
    ``embed``. Those of ``source`` may differ where texts are equal: then the pairs of the second
    and third rule are included.
    """
    condition = F.col("id_a") < F.col("id_b") if condition is None else condition
    rows = rows.withColumn("dob", text.known_dob("dob"))
    floors = (min(limits.high, limits.address),) * 2 + (limits.address,)
    first, last, address = (
        similar_texts(rows if source is None else source, block, column, score, floor, embed, bound)
        for column, score, floor in zip(RECORD_VECTORS, rules.SCORES, floors)
    )
    on = _VECTOR_KEYS if embed is None else {c: c for c in RECORD_VECTORS}
    a, b = (
        rows.withColumnsRenamed(
            {c: f"{c}_{side}" for c in rows.columns if c not in (*block, "dob")}
        )
        for side in "ab"
    )
    pairs = (
        a.join(first, [*block, f"{on['firstname']}_a"])
        .join(last, [*block, f"{on['lastname']}_a"])
        .join(b, [*block, "dob", f"{on['firstname']}_b", f"{on['lastname']}_b"])
        .filter(condition)
        .join(address, [*block, f"{on['address']}_a", f"{on['address']}_b"], "left")
    )
    pairs = pairs.withColumns({"dob_a": F.col("dob"), "dob_b": F.col("dob")})
    return pairs.withColumn("match_type", rules.match_label(limits))


def _weight(same: Column, n_a: Column, n_b: Column) -> Column:
    return F.when(same, pairs_among(n_a)).otherwise(n_a * n_b)


def match_type_counts(
    records: DataFrame,
    embed: Embedder,
    block: Sequence[str] = ("task_id",),
    limits: rules.Thresholds = rules.Thresholds(),
) -> DataFrame:
    """Number of pairs under each label, equal to counting the labelled pair relation.

    Strong pairs are counted over profiles. Pairs with near last names are counted from
    the number of records behind each name, and the rest is what remains of n(n-1)/2.
    """
    _check_edits(limits)
    block = list(block)
    records = records.filter(known(block))
    # Read for each kind of text and for both sides of the join.
    folded = durable(profiles(records, block))
    bound = measure(folded, block)
    labelled = _similar_name_pairs(
        folded, block, limits, embed, F.col("id_a") <= F.col("id_b"), bound
    )
    weight = _weight(F.col("id_a") == F.col("id_b"), F.col("copies_a"), F.col("copies_b"))
    near = text.within_edits("lastname_a", "lastname_b", _MAX_EDITS)
    label = F.col("match_type")
    strong = labelled.agg(
        *[_total(weight, label == name).alias(f"c{i}") for i, name in enumerate(STRONG)],
        _total(weight, label.isin(*STRONG) & near).alias("strong_near"),
    )

    named = records.filter(F.col("lastname").isNotNull())
    sizes = named.groupBy(*block, "lastname").agg(F.count("*").alias("n"))
    names = near_names(sizes, block, bound=bound)
    for side in "ab":
        names = names.join(
            sizes.withColumnsRenamed({"lastname": f"lastname_{side}", "n": f"n_{side}"}),
            [*block, f"lastname_{side}"],
        )
    same_name = F.col("lastname_a") == F.col("lastname_b")
    near_pairs = names.agg(_total(_weight(same_name, F.col("n_a"), F.col("n_b"))).alias("near"))
    all_pairs = block_sizes(records, block).agg(_total(F.col("pairs")).alias("total"))

    # Three single rows of sums, brought together into one.
    sums = reduce(
        lambda x, y: x.unionByName(y, allowMissingColumns=True), (strong, near_pairs, all_pairs)
    )
    sums = sums.agg(*[F.max(c).alias(c) for c in sums.columns])
    fuzzy = F.col("near") - F.col("strong_near")
    rest = F.col("total") - F.col("c0") - F.col("c1") - F.col("c2") - fuzzy
    counts = [F.col("c0"), F.col("c1"), F.col("c2"), fuzzy, rest]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("match_type"), count.alias("pairs"))
            for name, count in zip(rules.RULE_LABELS, counts)
        ]
    )
    return sums.select(F.inline(F.filter(rows, lambda r: r["pairs"] > 0)))


def _total(value: Column, condition: Column | None = None) -> Column:
    value = value if condition is None else F.when(condition, value)
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def matched_pairs(
    records: DataFrame,
    block: Sequence[str] = ("task_id",),
    limits: rules.Thresholds = rules.Thresholds(),
) -> DataFrame:
    """The labelled pairs other than ``No Match``, with their scores.

    Equals ``rules.match_pairs`` filtered, without forming the pairs that fail all rules.
    Records alike in all text columns and vectors are matched and scored as one profile, named
    by its lowest id, and only the matches of profiles are spelled out as pairs of records.
    Candidates are taken with a margin below the limits; the scores of the result decide.
    """
    _check_edits(limits)
    block = list(block)
    records = with_vector_keys(records.filter(known(block)))
    folded = durable(
        records.groupBy(*block, *_SHOWN).agg(F.count("*").alias("copies"), F.min("id").alias("id"))
    )
    bound = measure(folded, block)
    worthwhile = (F.col("id_a") < F.col("id_b")) | (
        (F.col("id_a") == F.col("id_b")) & (F.col("copies_a") > 1)
    )
    found_columns = [*block, "id_a", "id_b", "copies_b"]
    # Equal names, the first rule, are among the near last names below.
    loose = replace(limits, high=limits.high - _MARGIN, address=limits.address - _MARGIN)
    strong = _similar_name_pairs(
        folded, block, loose, condition=worthwhile, bound=bound, source=records
    ).filter(F.col("match_type").isin(*STRONG))

    named = folded.select(*block, "id", "copies", "lastname")
    near = near_names(named, block, bound=bound)
    # Each unordered pair of names is taken in both directions, a name with itself once.
    there = F.struct("lastname_a", "lastname_b")
    back = F.struct(F.col("lastname_b").alias("lastname_a"), F.col("lastname_a").alias("lastname_b"))
    fuzzy = near.select(*block, F.inline(F.array_distinct(F.array(there, back))))
    for side in "ab":
        names = {c: f"{c}_{side}" for c in ("lastname", "id", "copies")}
        fuzzy = fuzzy.join(named.withColumnsRenamed(names), [*block, f"lastname_{side}"])
    fuzzy = fuzzy.filter(worthwhile)
    found = strong.select(*found_columns).unionByName(fuzzy.select(*found_columns)).distinct()

    compared = [*_TEXTS, *RECORD_VECTORS.values()]
    pairs = found.withColumn("tiles", F.ceil(F.col("copies_b") / TILE_ROWS))
    for side in "ab":
        names = {c: f"{c}_{side}" for c in ("id", *compared)}
        sided = records.select(*block, *names).withColumnsRenamed(names)
        pairs = pairs.join(sided, [*block, f"id_{side}"])
    scores = {
        score: vectors.cosine_similarity(f"{vector}_a", f"{vector}_b")
        for score, vector in rules.SCORED_VECTORS.items()
    }
    scored = rules.pair_columns(pairs.withColumns(scores), block, True, "tiles")
    labelled = rules.label_pairs(scored, limits).filter(F.col("match_type") != rules.NO_MATCH)
    return _spelled_out(labelled, _members(records, folded, block), block)


_TEXTS = (*RECORD_VECTORS, "dob", "gender", "country")
_SHOWN = (*_TEXTS, *_VECTOR_KEYS.values())


def _members(records: DataFrame, folded: DataFrame, block: Sequence[str]) -> DataFrame:
    """``profile, id`` and the profile's number of copies, for every record."""
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*block, *_SHOWN)]
    joined = records.select(*block, "id", *_SHOWN).alias("r").join(
        folded.alias("f"), reduce(lambda x, y: x & y, same)
    )
    return joined.select(
        *[F.col(f"r.{c}").alias(c) for c in block], F.col("f.id").alias("profile"), "r.id", "copies"
    )


def _spelled_out(pairs: DataFrame, members: DataFrame, block: Sequence[str]) -> DataFrame:
    """Pairs of profiles as pairs of records, the lower id first.

    The records of a large profile are dealt to tiles, so that its pairs are not all made
    in one place.
    """
    a = members.select(*block, F.col("profile").alias("id_a"), F.col("id").alias("__x"))
    tile = F.coalesce(
        F.pmod(F.xxhash64("id"), F.ceil(F.col("copies") / TILE_ROWS)), F.lit(0)
    )
    b = members.select(
        *block, F.col("profile").alias("id_b"), F.col("id").alias("__y"), tile.alias("__tile")
    )
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))
    spelled = (
        pairs.withColumn("__tile", every)
        .join(a, [*block, "id_a"])
        .join(b, [*block, "id_b", "__tile"])
        .filter((F.col("id_a") != F.col("id_b")) | (F.col("__x") < F.col("__y")))
    )
    forward = F.col("__x") < F.col("__y")

    def turned(column: str) -> Column:
        if column == "id_a":
            return F.least("__x", "__y")
        if column == "id_b":
            return F.greatest("__x", "__y")
        other = _OTHER_SIDE.get(column)
        if other is None:
            return F.col(column)
        return F.when(forward, F.col(column)).otherwise(F.col(other))

    kept = [c for c in pairs.columns if c != "tiles"]
    return spelled.select(*[turned(c).alias(c) for c in kept])


_OTHER_SIDE = {
    f"{c}_{x}": f"{c}_{y}"
    for c in ("dob", "gender", "firstname", "lastname")
    for x, y in ("ab", "ba")
} | {"first_record": "second_record", "second_record": "first_record"}


def _check_edits(limits: rules.Thresholds) -> None:
    if limits.max_edits - 1 > _MAX_EDITS:
        raise ValueError("candidate keys cover last names at most two edits apart")
