"""From labelled pairs to groups of records, singletons and report rows.

A group is everything in a task that carries one label. A task has as many groups as
labels, so per task only a short list of groups is ever held in one row; the records of a
group stay rows of their own (``task_id, id, ...``) however many they are. List-valued
results are cut into pages, see ``paged_lists``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.text import parse_ids
from ..session import durable, shuffle_width
from .numbering import dense_numbers
from .pairs import measure
from .rules import HIGH_EARLIER, RULE_LABELS, SCORES, SINGLETON

GROUP_LABELS = (*RULE_LABELS, HIGH_EARLIER)
PAGE_WIDTH = 10_000
#: Labels are bits of a 32-bit number.
MAX_LABELS = 31


def total_score(pairs: DataFrame) -> DataFrame:
    """Sum of the three scores, read as numbers."""
    scores = [F.col(s).cast("double") for s in SCORES]
    return pairs.withColumns(dict(zip(SCORES, scores))).withColumn(
        "total_score", scores[0] + scores[1] + scores[2]
    )


def both_sides(pairs: DataFrame, *carried: str) -> DataFrame:
    """Every pair seen from each of its records: ``id`` and its ``partner``."""
    side = F.explode(
        F.array(
            F.struct(F.col("id_a").alias("id"), F.col("id_b").alias("partner")),
            F.struct(F.col("id_b").alias("id"), F.col("id_a").alias("partner")),
        )
    )
    return pairs.select(*carried, side.alias("s")).select(*carried, "s.id", "s.partner")


def best_first(score, id_a="id_a", id_b="id_b") -> Column:
    """The walk order of pairs: score descending, NULL last, then ids."""
    score = F.col(score) if isinstance(score, str) else score
    return F.struct(score.isNull().alias("unscored"), (-score).alias("cost"), id_a, id_b)


# -- group numbers ---------------------------------------------------------------------


def group_numbers(pairs: DataFrame) -> DataFrame:
    """``task_id, match_type, group_id``: labels of a task numbered by first appearance.

    Numbers run on over the tasks, in task order. One row per group.
    """
    first = pairs.groupBy("task_id", "match_type").agg(
        F.min(F.struct("id_a", "id_b")).alias("__first")
    )
    return dense_numbers(first, "task_id", "__first", name="group_id").drop("__first")


def with_group_id(pairs: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Add the group number to every pair."""
    numbers = group_numbers(pairs) if numbers is None else numbers
    return pairs.join(numbers, ["task_id", "match_type"])


# -- group selection -------------------------------------------------------------------


def _bit(match_type: Column, labels: Sequence[str]) -> Column:
    if len(labels) > MAX_LABELS:
        raise ValueError(f"{len(labels)} labels; at most {MAX_LABELS} can be told apart")
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), match_type)
    unknown = F.raise_error(F.concat(F.lit("unknown match type: "), match_type))
    return F.when(position > 0, (position - 1).cast("int")).otherwise(unknown.cast("int"))


def _flag(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), bit)


def selected_groups(pairs: DataFrame, labels: Sequence[str] = GROUP_LABELS) -> DataFrame:
    """Greedy selection of groups, plus singletons; one row per record of a group.

    Pairs of a task are walked by total score, best first. If neither record of a pair is
    in a chosen group yet, the group of that pair is chosen. Records in no chosen group
    become singletons. A record can be in several chosen groups.

    Which records are taken depends only on which labels were chosen, so a record is known
    by the set of labels it occurs under, and a pair by the union of its records' sets.
    Per task it is enough to keep the best pair of each (label, union): a short list,
    whatever the size of the task. The walk runs over that list.
    """
    width = len(labels)
    # Written once: it is read for the label sets, the best pairs and the group numbers.
    pairs = durable(
        total_score(pairs).select("task_id", "id_a", "id_b", "match_type", "total_score")
    )
    labelled = pairs.withColumn("bit", _bit(F.col("match_type"), labels))
    sets = (
        both_sides(labelled.withColumn("flag", _flag(F.col("bit"))), "task_id", "flag")
        .groupBy("task_id", "id")
        .agg(F.bit_or("flag").alias("labels"))
    )

    marked = labelled
    for side in "ab":
        marked = marked.join(
            sets.withColumnsRenamed({"id": f"id_{side}", "labels": f"labels_{side}"}),
            ["task_id", f"id_{side}"],
        )
    best = (
        marked.withColumn("union", F.col("labels_a").bitwiseOR(F.col("labels_b")))
        .groupBy("task_id", "bit", "union")
        .agg(F.min(F.struct(best_first("total_score").alias("place"), "total_score")).alias("top"))
    )
    # At most labels * 2^labels rows for a task, each a few numbers.
    walk = best.groupBy("task_id").agg(
        F.array_sort(
            F.collect_list(F.struct("top.place", "bit", "union", "top.total_score"))
        ).alias("candidates")
    )
    nothing = F.struct(
        F.lit(0).alias("taken"),
        F.array().cast("array<struct<bit:int,total_score:double>>").alias("chosen"),
    )

    def step(state: Column, pair: Column) -> Column:
        free = pair["union"].bitwiseAND(state["taken"]) == 0
        chosen = F.struct(pair["bit"].alias("bit"), pair["total_score"].alias("total_score"))
        grown = F.struct(
            state["taken"].bitwiseOR(_flag(pair["bit"])).alias("taken"),
            F.concat(state["chosen"], F.array(chosen)).alias("chosen"),
        )
        return F.when(free, grown).otherwise(state)

    chosen = walk.select("task_id", F.aggregate("candidates", nothing, step)["chosen"].alias("chosen"))
    numbered = _numbered_choices(chosen, group_numbers(pairs), labels)

    own = F.filter("chosen", lambda g: F.col("labels").bitwiseAND(_flag(g["bit"])) != 0)
    alone = F.array(
        F.struct(
            F.lit(SINGLETON).alias("match_type"),
            F.lit(0.0).alias("total_score"),
            F.lit(-1).cast("bigint").alias("group_id"),
            F.lit(width).alias("bit"),
        )
    )
    return (
        sets.join(numbered, "task_id")
        .withColumn("g", F.explode(F.when(F.size(own) > 0, own).otherwise(alone)))
        .select("task_id", "id", "g.match_type", "g.total_score", "g.group_id")
    )


def _numbered_choices(chosen: DataFrame, numbers: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per task, the chosen groups with label and group number."""
    names = F.array(*[F.lit(x) for x in labels])
    flat = chosen.select("task_id", F.explode("chosen").alias("c")).select(
        "task_id",
        "c.bit",
        "c.total_score",
        F.element_at(names, F.col("c.bit") + 1).alias("match_type"),
    )
    return (
        flat.join(numbers, ["task_id", "match_type"])
        .groupBy("task_id")
        .agg(F.collect_list(F.struct("match_type", "total_score", "group_id", "bit")).alias("chosen"))
    )


def group_lists(members: DataFrame, page_width: int = PAGE_WIDTH) -> DataFrame:
    """Selected groups with their ids as a list; each singleton is a group of its own."""
    single = F.when(F.col("match_type") == SINGLETON, F.col("id"))
    keyed = members.withColumn("__single", F.coalesce(single, F.lit(-1)))
    keys = ["task_id", "match_type", "total_score", "group_id", "__single"]
    return paged_lists(keyed, keys, "id", "group", page_width).drop("__single")


# -- one-to-one selection --------------------------------------------------------------


#: Pairs of a task that are settled in one place.
CELL_PAIRS = 100_000


def matched_couples(pairs: DataFrame, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """Greedy one-to-one matching: pairs by total score, each record used once per task.

    Every round settles what can be told locally, then what hangs together in chains. The
    records of a task are dealt to cells, one for every ``cell_pairs`` pairs, and a cell walks
    its pairs, best first; a pair that leads to another cell leaves its record in doubt, and
    with it every worse pair of that record. Of the pairs left, one that is the best of both
    its records is taken. One that is the best of one record and the second of the other is
    taken exactly if the pair before it is not: such chains, however long, are followed by
    doubling steps. The result is that of the walk, since the order of pairs is total.
    """
    result, round_ = None, 0
    remaining = durable(
        total_score(pairs).select("task_id", "id_a", "id_b", "match_type", "total_score")
    )
    while True:
        settled = durable(_settled(remaining, max(1, cell_pairs), round_))
        taken = settled.where("taken").drop("taken")
        result = taken if result is None else result.unionByName(taken)
        remaining = durable(_without(settled.where("NOT taken").drop("taken"), taken))
        if remaining.isEmpty():
            return result
        taken = durable(_chained(remaining))
        result = result.unionByName(taken)
        remaining = durable(_without(remaining, taken))
        if remaining.isEmpty():
            return result
        round_ += 1


def _settled(pairs: DataFrame, cell_pairs: int, round_: int) -> DataFrame:
    """Pairs with ``taken``; pairs that a cell knows to be lost are left out."""
    bound = measure(pairs, ["task_id"])
    cells = F.lit(1)
    if bound.largest > cell_pairs:
        sizes = pairs.groupBy("task_id").agg(F.count("*").alias("__n"))
        large = durable(
            sizes.where(F.col("__n") > cell_pairs).select(
                "task_id", F.ceil(F.col("__n") / cell_pairs).alias("__cells")
            )
        )
        pairs = pairs.join(large, "task_id", "left")
        cells = F.coalesce(F.col("__cells"), F.lit(1))
    cell = lambda c: F.pmod(F.xxhash64(F.lit(round_), F.col(c)), cells)
    placed = pairs.withColumns({"__a": cell("id_a"), "__b": cell("id_b")})
    both = F.array_distinct(F.array("__a", "__b"))
    # many small tasks, or some cells of a large one, share a place
    width = max(1, -(-bound.total // cell_pairs), min(shuffle_width(pairs), bound.total // 1000))
    walked = placed.withColumn("__cell", F.explode(both)).withColumn(
        "__group", F.pmod(F.xxhash64("task_id", "__cell"), F.lit(width))
    )
    order = best_first("total_score")
    walked = walked.withColumns({"__unscored": order["unscored"], "__cost": order["cost"]})
    names = ["task_id", "id_a", "id_b", "match_type", "total_score"]

    def walk(table: pa.Table) -> pa.Table:
        keys = ("__unscored", "__cost", "id_a", "id_b")
        table = table.take(pc.sort_indices(table, [(k, "ascending") for k in keys]))
        place = _codes([table.column("task_id"), table.column("__cell")])
        ids = pa.chunked_array([*table.column("id_a").chunks, *table.column("id_b").chunks])
        records = _codes([pa.chunked_array([pa.array(np.tile(place, 2))]), ids])
        n = table.num_rows
        cell = table.column("__cell").to_numpy()
        here = [table.column(c).to_numpy() == cell for c in ("__a", "__b")]
        free, used, doubtful = 0, 1, 2
        state = bytearray(int(records.max()) + 1)
        kept, taken = [], []
        rows = zip(records[:n].tolist(), records[n:].tolist(), here[0].tolist(), here[1].tolist(), strict=True)
        for k, (a, b, a_here, b_here) in enumerate(rows):
            if a_here and state[a] == used or b_here and state[b] == used:
                continue
            if a_here and b_here and state[a] == free and state[b] == free:
                state[a] = state[b] = used
                kept.append(k)
                taken.append(True)
                continue
            if a_here:
                state[a] = doubtful
                kept.append(k)  # the cell of a speaks for the pair
                taken.append(False)
            if b_here:
                state[b] = doubtful
        out = table.select(names).take(pa.array(kept, pa.int64()))
        return out.append_column("taken", pa.array(taken, pa.bool_()))

    schema = T.StructType([*(pairs.schema[c] for c in names), T.StructField("taken", T.BooleanType())])
    return walked.select(*names, "__a", "__b", "__cell", "__group", "__unscored", "__cost").groupBy(
        "__group"
    ).applyInArrow(walk, schema)


def _codes(columns: Sequence[pa.ChunkedArray]) -> np.ndarray:
    """A number for every different row of the columns."""
    codes = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        own = column.combine_chunks()
        own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
        own = own.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return codes


def _without(pairs: DataFrame, taken: DataFrame) -> DataFrame:
    """Pairs none of whose records is in a taken pair."""
    gone = taken.select("task_id", F.explode(F.array("id_a", "id_b")).alias("id"))
    for side in "ab":
        pairs = pairs.join(
            gone.withColumnRenamed("id", f"id_{side}"), ["task_id", f"id_{side}"], "left_anti"
        )
    return pairs.select("task_id", "id_a", "id_b", "match_type", "total_score")


def _chained(pairs: DataFrame) -> DataFrame:
    """Pairs that are taken for being the best of both records, or by a chain from such a pair."""
    sided = pairs.select(
        "task_id", best_first("total_score").alias("place"), F.explode(F.array("id_a", "id_b")).alias("id")
    )
    own = W.partitionBy("task_id", "id").orderBy("place")
    upwards = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    top = sided.withColumns(
        {"rank": F.row_number().over(own), "best": F.first("place").over(upwards)}
    ).where("rank <= 2")
    pair = top.groupBy("task_id", "place").agg(
        F.count("*").alias("sides"),
        F.max("rank").alias("rank"),
        F.max(F.when(F.col("rank") == 2, F.col("best"))).alias("before"),
        F.min("rank").alias("low"),
    )
    pair = durable(
        pair.where("sides = 2 AND low = 1").select(
            "task_id",
            F.col("place.id_a").alias("id_a"),
            F.col("place.id_b").alias("id_b"),
            F.col("before.id_a").alias("to_a"),
            F.col("before.id_b").alias("to_b"),
            (F.col("rank") == 2).alias("turned"),
        )
    )
    won = pair.where("NOT turned").select("task_id", "id_a", "id_b")
    links = pair.where("turned").withColumn("more", F.lit(True))
    while True:
        further = links.select(
            "task_id",
            F.col("id_a").alias("to_a"),
            F.col("id_b").alias("to_b"),
            F.col("to_a").alias("then_a"),
            F.col("to_b").alias("then_b"),
            F.col("turned").alias("then_turned"),
        )
        links = durable(
            links.join(further, ["task_id", "to_a", "to_b"], "left").select(
                "task_id",
                "id_a",
                "id_b",
                F.coalesce("then_a", "to_a").alias("to_a"),
                F.coalesce("then_b", "to_b").alias("to_b"),
                # two turns are none
                (F.col("turned") != F.coalesce("then_turned", F.lit(False))).alias("turned"),
                F.col("then_a").isNotNull().alias("more"),
            )
        )
        if links.where("more").isEmpty():
            break
    ends = won.withColumnsRenamed({"id_a": "to_a", "id_b": "to_b"})
    chained = links.where("NOT turned").join(ends, ["task_id", "to_a", "to_b"], "left_semi")
    keys = won.unionByName(chained.select("task_id", "id_a", "id_b"))
    return pairs.join(keys, ["task_id", "id_a", "id_b"], "left_semi")


# -- joining groups to records ---------------------------------------------------------


def explode_groups(groups: DataFrame, column: str = "group") -> DataFrame:
    """One row per record of a group; the list may also be text such as ``'2,4'``."""
    if groups.schema[column].dataType.simpleString() == "string":
        groups = groups.withColumn(column, parse_ids(column))
    others = [c for c in groups.columns if c != column]
    return groups.select(*others, F.explode(column).alias("id"))


def with_originals(members: DataFrame, originals: DataFrame) -> DataFrame:
    """Left join to the original records on task and id; both key sets are kept."""
    taken = {c.lower() for c in members.columns}
    right = originals.toDF(
        *[f"{c}_original" if c.lower() in taken else c for c in originals.columns]
    )
    same = (F.col("task_id") == F.col("task_id_original")) & (F.col("id") == F.col("id_original"))
    return members.join(right, same, "left")


def grouped_records(
    pairs: DataFrame,
    originals: DataFrame,
    keep_unpaired: bool = False,
    labels: Sequence[str] = GROUP_LABELS,
) -> DataFrame:
    """The whole result: groups and singletons, one row per record, with its original.

    A record alone in its task is in no pair and so in no row, unless ``keep_unpaired``.
    """
    members = selected_groups(pairs, labels)
    if keep_unpaired:
        alone = originals.join(members, ["task_id", "id"], "left_anti").select(
            "task_id",
            "id",
            F.lit(SINGLETON).alias("match_type"),
            F.lit(0.0).alias("total_score"),
            F.lit(-1).cast("bigint").alias("group_id"),
        )
        members = members.unionByName(alone)
    return with_originals(members, originals)


# -- reports by match type -------------------------------------------------------------


def ids_by_match_type(pairs: DataFrame, *by: str) -> DataFrame:
    """Distinct records per label (and per ``by``, e.g. ``task_id``), one row each."""
    return both_sides(pairs, "match_type", *by).drop("partner").distinct()


def first_pairs(pairs: DataFrame, *carried: str) -> DataFrame:
    """For every record, its first pair by (id_a, id_b), whatever its label and task."""
    row = F.struct("id_a", "id_b", *carried)
    sided = pairs.select(row.alias("pair")).select(
        "pair", F.explode(F.array("pair.id_a", "pair.id_b")).alias("id")
    )
    order = F.struct("pair.id_a", "pair.id_b")
    return sided.groupBy("id").agg(F.min_by("pair", order).alias("pair"))


def _own_side(column: str) -> Column:
    is_a = F.col("id") == F.col("pair.id_a")
    return F.when(is_a, F.col(f"pair.{column}_a")).otherwise(F.col(f"pair.{column}_b"))


def record_rows(pairs: DataFrame) -> DataFrame:
    """One row per (label, record): the record, and the scores of its first pair as text."""
    firsts = first_pairs(pairs, "first_record", "second_record", "combined_scores")
    record = F.when(F.col("id") == F.col("pair.id_a"), F.col("pair.first_record")).otherwise(
        F.col("pair.second_record")
    )
    return (
        ids_by_match_type(pairs)
        .join(firsts, "id")
        .select(
            "id",
            record.alias("first_record"),
            "match_type",
            F.col("pair.combined_scores").alias("similarity_score_fn_ln_adrs"),
        )
    )


def task_record_rows(pairs: DataFrame) -> DataFrame:
    """One row per (label, task, record): the record's fields and its task's first scores."""
    carried = [f"{c}_{s}" for c in ("firstname", "lastname", "dob") for s in "ab"]
    firsts = first_pairs(pairs, *carried, "first_record", "second_record")
    task_scores = pairs.groupBy("task_id").agg(
        F.min_by(F.struct(*SCORES), F.struct("id_a", "id_b")).alias("scores")
    )
    record = F.when(F.col("id") == F.col("pair.id_a"), F.col("pair.first_record")).otherwise(
        F.col("pair.second_record")
    )
    return (
        ids_by_match_type(pairs, "task_id")
        .join(firsts, "id")
        .join(task_scores, "task_id")
        .select(
            "id",
            "task_id",
            *[_own_side(c).alias(c) for c in ("firstname", "lastname", "dob")],
            record.alias("first_record"),
            "match_type",
            *[F.col(f"scores.{s}").alias(s) for s in SCORES],
        )
    )


# -- list-valued reports ---------------------------------------------------------------


def paged_lists(
    rows: DataFrame, keys: Sequence[str], value: str, name: str, page_width: int = PAGE_WIDTH
) -> DataFrame:
    """Sorted list of the distinct values per key, as ``<name>`` with a ``page`` number.

    Page p holds the values from place ``p * page_width`` of the key's sorted values, so no list
    outgrows a row however many rows a key has. Values of any sortable type will do.
    """
    keys = list(keys)
    distinct = rows.select(*keys, F.col(value).alias("__value")).distinct()
    order = [*keys, F.col("__value").asc_nulls_last()]
    placed = dense_numbers(distinct, *order, name="__place")
    first = placed.groupBy(*keys).agg(F.min("__place").alias("__first"))
    same = reduce(lambda x, y: x & y, [F.col(f"p.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys])
    page = F.floor((F.col("__place") - F.col("__first")) / page_width)
    paged = placed.alias("p").join(first.alias("f"), same).select(
        *[F.col(f"p.{k}") for k in keys],
        # a NULL is in no list, and is last
        F.when(F.col("__value").isNull(), 0).otherwise(page).alias("page"),
        "__value",
    )
    return paged.groupBy(*keys, "page").agg(F.sort_array(F.collect_list("__value")).alias(name))


def id_lists_by_match_type(pairs: DataFrame, *by: str) -> DataFrame:
    """Distinct ids per label (and ``by``) as lists."""
    return paged_lists(ids_by_match_type(pairs, *by), ["match_type", *by], "id", "distinct_ids")


def partner_lists(pairs: DataFrame) -> DataFrame:
    """Per label and record, the records it was paired with."""
    return paged_lists(
        both_sides(pairs, "match_type"), ["match_type", "id"], "partner", "partners"
    )


def partner_table(pairs: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The partner lists of a few named records, one column each, one row per label."""
    sided = both_sides(pairs, "match_type").filter(F.col("id").isin(*ids))
    lists = paged_lists(sided, ["match_type", "id"], "partner", "partners")
    return lists.groupBy("match_type", "page").pivot("id", list(ids)).agg(F.any_value("partners", True))


def pair_lists(pairs: DataFrame) -> DataFrame:
    """Per label, its ``[id_a, id_b]`` pairs in order, cut into pages by place."""
    rows = pairs.select("match_type", F.array("id_a", "id_b").alias("pair"))
    return paged_lists(rows, ["match_type"], "pair", "id_pairs")


def lists_by_first_id(pairs: DataFrame) -> DataFrame:
    """Per ``id_a``, its labels and its partners."""
    partners = paged_lists(pairs.select("id_a", "id_b"), ["id_a"], "id_b", "partners")
    labels = pairs.groupBy("id_a").agg(F.sort_array(F.collect_set("match_type")).alias("match_types"))
    return partners.join(labels, "id_a")


def merged_sets(rows: DataFrame, key: str, values: str) -> DataFrame:
    """Union of the value lists of each key."""
    return paged_lists(
        rows.select(key, F.explode(values).alias("value")).distinct(), [key], "value", values
    )
