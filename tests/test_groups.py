import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import groups, numbering
from recordloom.operators.rules import ADDRESS, EXACT, FUZZY, HIGH, NO_MATCH, RULE_LABELS, SINGLETON
from tests import brute

SCHEMA = (
    "task_id long, id_a long, id_b long, match_type string,"
    " fn_similarity_score double, ln_similarity_score double, adrs_similarity_score double"
)


def frame_of(spark, pairs):
    rows = [
        (p["task"], p["a"], p["b"], p["label"], p["score"], 0.0, 0.0) for p in pairs
    ]
    return spark.createDataFrame(rows, SCHEMA)


def random_pairs(seed, tasks=12, size=7):
    """Tasks of random pairs with ties and missing scores; some pairs are left out."""
    rng = random.Random(seed)
    out = []
    for task in range(tasks):
        ids = range(task * 100, task * 100 + rng.randint(2, size))
        for a in ids:
            for b in ids:
                if a < b and rng.random() < 0.8:
                    score = None if rng.random() < 0.1 else rng.randint(0, 6) / 2
                    out.append(dict(task=task, a=a, b=b, label=rng.choice(RULE_LABELS), score=score))
    return out


def bridged():
    """A star whose weakest pair has the label of a far pair, a tie, and a pair without score."""
    rows = [
        (70, 201, 205, EXACT, 1.5), (70, 201, 209, NO_MATCH, 0.25), (70, 205, 213, NO_MATCH, 1.75),
        (70, 209, 213, EXACT, 1.5), (70, 213, 217, FUZZY, None),
        (82, 301, 304, NO_MATCH, 0.5), (82, 304, 307, EXACT, 0.5), (82, 310, 313, EXACT, 0.125),
    ]
    return [dict(zip(("task", "a", "b", "label", "score"), r)) for r in rows]


def test_bridged_groups(spark, rows):
    pairs = bridged()
    frame = frame_of(spark, pairs)
    numbered = brute.numbers(pairs)
    assert rows(groups.group_numbers(frame)) == sorted(
        ((t, label, n) for (t, label), n in numbered.items()), key=repr
    )
    got = groups.selected_groups(frame)
    want = brute.grouped(pairs)
    assert rows(got, "task_id", "id", "match_type", "total_score") == sorted(want, key=repr)
    members = {}
    for task, record, label, score in want:
        key = (task, label, score) if label != SINGLETON else (task, record)
        members.setdefault((task, key), []).append(record)
    assert rows(groups.group_lists(got), "task_id", "group") == sorted(
        ((task, sorted(ids)) for (task, _), ids in members.items()), key=repr
    )


def test_too_many_labels_are_refused(spark):
    with pytest.raises(ValueError, match="40 labels"):
        groups.selected_groups(frame_of(spark, bridged()), labels=[f"l{i}" for i in range(40)])


@pytest.mark.parametrize("seed", range(4))
def test_selection_equals_the_walk(spark, seed):
    pairs = random_pairs(seed)
    got = groups.selected_groups(frame_of(spark, pairs)).collect()
    assert {(r.task_id, r.id, r.match_type, r.total_score) for r in got} == brute.grouped(pairs)
    assert len(got) == len(brute.grouped(pairs))
    numbered = brute.numbers(pairs)
    assert all(r.group_id == numbered.get((r.task_id, r.match_type), -1) for r in got)


@pytest.mark.parametrize("walk_limit", [0, 6, 10_000])
@pytest.mark.parametrize("seed", [5, 6])
def test_couples_equal_the_walk(spark, seed, walk_limit):
    pairs = random_pairs(seed)
    got = groups.matched_couples(frame_of(spark, pairs), walk_limit).collect()
    assert {(r.task_id, r.id_a, r.id_b, r.match_type, r.total_score) for r in got} == brute.couples(pairs)
    assert len(got) == len(brute.couples(pairs))


def test_unknown_labels_are_refused_unless_named(spark):
    pairs = frame_of(spark, [dict(task=1, a=1, b=2, label="mine", score=1.0)])
    with pytest.raises(Exception, match="unknown match type"):
        groups.selected_groups(pairs).collect()
    assert groups.selected_groups(pairs, ["mine"]).count() == 2


def test_grouped_records_keep_both_key_sets(spark, rows):
    members = sorted({(p["task"], p[side]) for p in bridged() for side in "ab"})
    chosen = sorted(i for _, i, _, _ in brute.grouped(bridged()))
    originals = spark.createDataFrame(
        [(t, i, f"n{i}") for t, i in [*members, (93, 400)]],
        "task_id long, id long, firstname string",
    )
    pairs = frame_of(spark, bridged())
    got = groups.grouped_records(pairs, originals)
    assert got.columns[-3:] == ["task_id_original", "id_original", "firstname"]
    assert sorted(r.id for r in got.collect()) == chosen
    assert all(r.id == r.id_original and r.firstname == f"n{r.id}" for r in got.collect())
    kept = groups.grouped_records(pairs, originals, keep_unpaired=True)
    assert rows(kept.filter("task_id = 93"), "id", "match_type") == [(400, SINGLETON)]
    upper = originals.toDF("TASK_ID", "ID", "FIRSTNAME")
    assert groups.grouped_records(pairs, upper).count() == len(chosen)


def test_text_lists_are_read(spark, rows):
    frame = spark.createDataFrame([(111, "2,4", HIGH)], "task_id long, `group` string, match_type string")
    assert rows(groups.explode_groups(frame), "task_id", "id") == [(111, 2), (111, 4)]


# -- reports ---------------------------------------------------------------------------


def test_first_pair_ignores_label_and_task(spark):
    pairs = spark.createDataFrame(
        [(1, 1, 2, NO_MATCH, "one", "two", "s12"), (1, 1, 3, HIGH, "one", "three", "s13"),
         (1, 2, 3, NO_MATCH, "two", "three", "s23")],
        "task_id long, id_a long, id_b long, match_type string, first_record string,"
        " second_record string, combined_scores string",
    )
    got = {(r.match_type, r.id): (r.first_record, r.similarity_score_fn_ln_adrs) for r in groups.record_rows(pairs).collect()}
    assert got[(NO_MATCH, 3)] == ("three", "s13")
    assert got[(HIGH, 1)] == ("one", "s12")
    assert set(got) == {(NO_MATCH, 1), (NO_MATCH, 2), (NO_MATCH, 3), (HIGH, 1), (HIGH, 3)}


def test_lists_of_large_keys_are_paged(spark):
    frame = spark.createDataFrame([("x", i) for i in range(50)] + [("y", 3), ("y", 1)], "k string, v long")
    got = {(r.k, r.page): r.l for r in groups.paged_lists(frame, ["k"], "v", "l", page_width=20).collect()}
    assert got[("y", 0)] == [1, 3]
    assert [len(got[("x", p)]) for p in range(3)] == [20, 20, 10]
    assert sorted(sum((v for (k, _), v in got.items() if k == "x"), [])) == list(range(50))


def test_pages_go_by_place_for_every_size_and_type(spark):
    rows = [("sparse", 10**15 * i) for i in range(45)] + [("few", -(10**17)), ("few", 5), ("few", 5), ("none", None)]
    rows += [("full", i) for i in range(20)] + [("full", None), (None, 7)]
    frame = spark.createDataFrame(rows, "k string, v long")
    for shown in (frame, frame.where("v IS NOT NULL").withColumn("v", F.format_string("%020d", "v"))):
        got = {(r.k, r.page): r.l for r in groups.paged_lists(shown, ["k"], "v", "l", page_width=20).collect()}
        assert [len(got[("sparse", p)]) for p in range(3)] == [20, 20, 5]
        values = sum((got[("sparse", p)] for p in range(3)), [])
        assert [int(v) for v in values] == [10**15 * i for i in range(45)]
        assert len(got[("few", 0)]) == 2 and len(got[("full", 0)]) == 20 and len(got[(None, 0)]) == 1
        assert not {("full", 1), ("few", 1), ("sparse", 3)} & set(got)
    got = groups.paged_lists(frame, ["k"], "v", "l", page_width=20).where("k = 'none'").collect()
    assert [(r.page, r.l) for r in got] == [(0, [])]


def test_partner_table(spark):
    cycle = [(1, 3, HIGH), (2, 4, HIGH), (5, 6, ADDRESS)]
    other = [(a, b, NO_MATCH) for a in range(1, 7) for b in range(a + 1, 7) if (a, b) not in {(1, 3), (2, 4), (5, 6)}]
    pairs = frame_of(spark, [dict(task=1, a=a, b=b, label=x, score=1.0) for a, b, x in cycle + other])
    got = {r["match_type"]: r.asDict() for r in groups.partner_table(pairs, range(1, 7)).collect()}
    assert got[NO_MATCH]["1"] == [2, 4, 5, 6] and got[NO_MATCH]["5"] == [1, 2, 3, 4]
    assert got[HIGH]["1"] == [3] and got[HIGH]["5"] is None
    assert got[ADDRESS]["6"] == [5]


def test_merged_sets(spark, rows):
    frame = spark.createDataFrame([(1, [2, 4]), (1, [4, 3]), (5, [6])], "k long, v array<bigint>")
    assert rows(groups.merged_sets(frame, "k", "v"), "k", "v") == [(1, [2, 3, 4]), (5, [6])]


def test_lists_by_first_id(spark, rows):
    pairs = frame_of(spark, bridged())
    got = {r.id_a: (r.partners, r.match_types) for r in groups.lists_by_first_id(pairs).collect()}
    assert got[201] == ([205, 209], sorted([EXACT, NO_MATCH])) and got[213] == ([217], [FUZZY])


# -- numbering -------------------------------------------------------------------------


def test_dense_numbers_over_many_partitions(spark):
    frame = spark.range(1000).withColumn("k", (F.col("id") * 37) % 1009).repartition(13)
    got = numbering.dense_numbers(frame, F.col("k").desc(), name="n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001))
    assert [r.k for r in got] == sorted((r.k for r in got), reverse=True)


def test_scan_order_numbers(spark):
    got = numbering.dense_numbers(spark.range(0, 100, 1, 7), name="n").orderBy("n").collect()
    assert [(r.id, r.n) for r in got] == [(i, i + 1) for i in range(100)]


def test_running_totals(spark):
    frame = spark.range(200).repartition(9)
    got = numbering.running_totals(frame, ["id"], {"before": F.col("id") * 2}).collect()
    assert all(r.before == r.id * (r.id - 1) for r in got)


def test_every_label_can_be_selected(spark):
    pairs = [dict(task=1, a=2 * i, b=2 * i + 1, label=x, score=1.0) for i, x in enumerate(RULE_LABELS)]
    got = groups.selected_groups(frame_of(spark, pairs)).collect()
    assert len(got) == 10 and {r.match_type for r in got} == set(RULE_LABELS)
    assert EXACT in {r.match_type for r in got}
