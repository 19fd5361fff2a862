import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import vectors
from recordloom.operators import candidates, pairs, rules, tiles
from recordloom.schemas import RECORD_VECTORS
from tests.brute import edits

RNG = random.Random(11)


def skewed(spark, n=60):
    """A third of the rows in one block, some in none, NULL and zero vectors among them."""
    out = []
    for i in range(n):
        block = 1 if i % 3 == 0 else (None if i % 17 == 0 else i % 7 + 10)
        vector = None if i % 13 == 0 else [float(RNG.randint(0, 2)) for _ in range(3)]
        out.append((block, i, f"m{i}", vector))
    return spark.createDataFrame(out, "task_id long, id long, name string, v array<float>"), out


def expected_pairs(data):
    return sorted(
        (a[0], a[1], b[1])
        for a in data
        for b in data
        if a[0] is not None and a[0] == b[0] and a[1] < b[1]
    )


@pytest.mark.parametrize("tile_rows", [2, 5, 1000])
def test_join_pairs_each_block_whole(spark, rows, tile_rows):
    frame, data = skewed(spark)
    got = pairs.self_pairs(frame, tile_rows=tile_rows).select("a.task_id", "a.id", F.col("b.id").alias("id_b"))
    assert rows(got) == sorted(expected_pairs(data), key=repr)


def test_join_by_text_order(spark, rows):
    frame, data = skewed(spark)
    got = pairs.self_pairs(frame, id_column="name", tile_rows=4).select(
        F.col("a.name").alias("x"), F.col("b.name").alias("y")
    )
    want = [(a[2], b[2]) for a in data for b in data if a[0] is not None and a[0] == b[0] and a[2] < b[2]]
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("tile_rows", [7, 1000])
def test_all_pairs(spark, tile_rows):
    frame, data = skewed(spark, 40)
    assert pairs.all_pairs(frame, tile_rows=tile_rows).count() == 40 * 39 // 2
    both = pairs.all_pairs(frame, condition=F.col("a.name") != F.col("b.name"), tile_rows=tile_rows)
    assert both.count() == 40 * 39


def test_no_cross_join_in_the_plan(spark):
    frame, _ = skewed(spark)
    for joined in (pairs.self_pairs(frame), pairs.all_pairs(frame), pairs.self_pairs(frame, tile_rows=3)):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("tile_rows", [2, 6, 1000])
def test_tiles_equal_the_join(spark, rows, tile_rows):
    frame, data = skewed(spark)
    got = tiles.similar_pairs(frame, ["task_id"], "id", {"s": "v"}, tile_rows=tile_rows)
    assert got.columns == ["task_id", "id_a", "id_b", "name_a", "name_b", "s"]
    joined = pairs.self_pairs(frame).select(
        "a.task_id",
        F.col("a.id").alias("id_a"),
        F.col("b.id").alias("id_b"),
        F.col("a.name").alias("name_a"),
        F.col("b.name").alias("name_b"),
        vectors.cosine_similarity("a.v", "b.v").alias("s"),
    )
    rounded = F.round("s", 9).alias("s")
    assert rows(got.withColumn("s", rounded)) == rows(joined.withColumn("s", rounded))


def test_tiles_with_a_limit_and_no_block(spark, rows):
    frame, data = skewed(spark)
    got = tiles.similar_pairs(frame, [], "name", {"s": "v"}, above=0.9, tile_rows=10)
    joined = pairs.all_pairs(frame, "name").select(
        F.col("a.name").alias("name_a"),
        F.col("b.name").alias("name_b"),
        vectors.cosine_similarity("a.v", "b.v").alias("s"),
    )
    assert rows(got, "name_a", "name_b") == rows(joined.filter("s > 0.9"), "name_a", "name_b")


def test_tiles_compare_different_vectors(spark, rows):
    frame, _ = skewed(spark)
    frame = frame.withColumn("w", F.reverse("v"))
    got = tiles.similar_pairs(frame, ["task_id"], "id", {"s": ("v", "w")}, tile_rows=4)
    joined = pairs.self_pairs(frame).select(
        F.col("a.id").alias("id_a"),
        F.col("b.id").alias("id_b"),
        F.round(vectors.cosine_similarity("a.v", "b.w"), 9).alias("s"),
    )
    assert rows(got.select("id_a", "id_b", F.round("s", 9))) == rows(joined)


@pytest.mark.parametrize("tile_rows", [3, 1000])
def test_rows_of_one_id_are_not_paired(spark, rows, tile_rows):
    data = [("t", f"m{i % 5}", float(i), [1.0, float(i)]) for i in range(14)]
    frame = spark.createDataFrame(data, "task_id string, mcid string, n double, v array<double>")
    got = tiles.similar_pairs(frame, ["task_id"], "mcid", {"s": "v"}, tile_rows=tile_rows)
    joined = pairs.self_pairs(frame, ["task_id"], "mcid")
    assert rows(got, "mcid_a", "mcid_b", "n_a", "n_b") == rows(joined, "a.mcid", "b.mcid", "a.n", "b.n")


def test_vectors_of_mixed_length_are_refused(spark):
    frame = spark.createDataFrame([(1, 1, [1.0]), (1, 2, [1.0, 2.0])], "task_id long, id long, v array<double>")
    with pytest.raises(Exception, match="same length"):
        tiles.similar_pairs(frame, ["task_id"], "id", {"s": "v"}).collect()


def test_block_sizes(spark, rows):
    frame = spark.createDataFrame([(1, i) for i in range(4)] + [(2, 9)], "task_id long, id long")
    assert rows(pairs.block_sizes(frame, ["task_id"])) == [(1, 4, 6), (2, 1, 0)]


# -- candidates ------------------------------------------------------------------------


def mutated(word, n):
    word = list(word)
    for _ in range(n):
        place = RNG.randint(0, len(word))
        kind = RNG.choice("ids")
        if kind == "i" or not word:
            word.insert(place, RNG.choice("ab"))
        elif kind == "d":
            word.pop(min(place, len(word) - 1))
        else:
            word[min(place, len(word) - 1)] = RNG.choice("ab")
    return "".join(word)


def test_texts_within_two_edits_share_a_key(spark):
    base = ["".join(RNG.choices("abc", k=k)) for k in [*range(0, 24), 16, 17, 18, 19, 40, 60]]
    texts = sorted({m for b in base for n in (0, 1, 2, 2, 3) for m in [mutated(b, n)]})
    frame = spark.createDataFrame([(1, t) for t in texts], "task_id long, lastname string")
    got = {(r["lastname_a"], r["lastname_b"]) for r in candidates.near_names(frame, ["task_id"]).collect()}
    assert got == {(s, t) for s in texts for t in texts if s <= t and edits(s, t) <= 2}


def people(spark, n=120):
    """Records with copies, near names, NULLs and texts without a letter."""
    first = ["anna", "nana", "bert", "berta", "12", None, "carla"]
    last = ["smith", "smyth", "smithe", "jones", "jonas", "a", "", None, "featherstonehaugh-smith"]
    out = [
        (
            1 if i % 3 == 0 else i % 5,
            i,
            RNG.choice(first),
            RNG.choice(last),
            RNG.choice(["here", "there", None]),
            RNG.choice(["1", "2", None]),
            RNG.choice(["m", "f", None]),
            "x",
        )
        for i in range(n)
    ]
    return spark.createDataFrame(
        out,
        "task_id long, id long, firstname string, lastname string, address string,"
        " dob string, gender string, country string",
    )


@pytest.mark.parametrize("block", [("task_id",), ()])
def test_matches_equal_the_labelled_pairs(spark, rows, block):
    records = people(spark)
    embedded = vectors.embed_letters(records, RECORD_VECTORS)
    everything = rules.match_pairs(embedded, block)
    counts = everything.groupBy("match_type").count()
    assert rows(candidates.match_type_counts(records, vectors.embed_letters, block)) == rows(counts)
    found = candidates.matched_pairs(embedded, block)
    assert found.columns == everything.columns
    columns = [c for c in found.columns if c not in rules.SCORES]
    columns += [F.round(s, 9) for s in rules.SCORES]
    assert rows(found, *columns) == rows(everything.filter("match_type <> 'No Match'"), *columns)


@pytest.mark.parametrize("seed", [3, 4])
def test_matches_by_vectors_that_differ_where_texts_are_equal(spark, rows, seed):
    rng = random.Random(seed)
    bases = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]

    def vector():
        kind = rng.random()
        near = [x + rng.gauss(0, 0.2) for x in rng.choice(bases)]
        return None if kind < 0.05 else [0.0] * 6 if kind < 0.1 else rng.choice(bases) if kind < 0.3 else near

    made = [(r.id, *(vector() for _ in RECORD_VECTORS)) for r in people(spark, 150).collect()]
    schema = "id long, " + ", ".join(f"{v} array<double>" for v in RECORD_VECTORS.values())
    embedded = people(spark, 150).join(spark.createDataFrame(made, schema), "id")
    embedded = spark.createDataFrame(embedded.collect(), embedded.schema)
    want = rules.match_pairs(embedded).filter("match_type <> 'No Match'")
    found = candidates.matched_pairs(embedded)
    columns = [c for c in found.columns if c not in rules.SCORES]
    columns += [F.round(s, 9) for s in rules.SCORES]
    assert rows(found, *columns) == rows(want, *columns) != []
    assert {rules.HIGH, rules.ADDRESS} <= {r.match_type for r in found.collect()}


def test_matches_of_large_profiles_are_dealt_to_tiles(spark, rows, monkeypatch):
    embedded = vectors.embed_letters(people(spark, 60).withColumn("lastname", F.lit("same")), RECORD_VECTORS)
    want = rules.match_pairs(embedded).filter("match_type <> 'No Match'")
    monkeypatch.setattr(candidates, "TILE_ROWS", 2)
    found = candidates.matched_pairs(embedded)
    columns = [c for c in found.columns if c not in rules.SCORES]
    assert rows(found, *columns) == rows(want, *columns) != []


def test_limits_beyond_the_keys_are_refused(spark):
    with pytest.raises(ValueError, match="two edits"):
        candidates.matched_pairs(people(spark), limits=rules.Thresholds(max_edits=4))


# -- rules -----------------------------------------------------------------------------


def test_rule_validation_starts_no_job(spark):
    records = vectors.embed_letters(people(spark), RECORD_VECTORS)
    spark.sparkContext.setJobGroup("validate", "")
    try:
        assert rules.validate_rule(records, "a.lastname = b.lastname;") == (True, None)
        good = "jaro_winkler_distance(a.lastname, b.lastname) > 0.9 AND a.dob = 'select'"
        assert rules.validate_rule(records, good) == (True, None)
        for bad in ("a.nothing = b.nothing", "a.id +", "java_method('x', 'y') = 1",
                    "a.id IN (SELECT 1)", "true; drop table x"):
            valid, message = rules.validate_rule(records, bad)
            assert not valid and message
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("validate")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_equalities_of_a_rule_become_join_keys(spark):
    records = vectors.embed_letters(people(spark), RECORD_VECTORS)
    plan = rules.rule_pairs(records, "a.lastname = b.lastname AND hamming_distance(a.dob, b.dob) = 0")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in text.splitlines() if "Join Inner" in line]
    assert joined and "lastname" in joined[0]


def test_statements_are_refused(spark):
    with pytest.raises(ValueError, match="not allowed"):
        rules.rule_pairs(people(spark), "a.id IN (SELECT id FROM x)")


def test_tiers_take_both_names_of_the_second_rule(spark, rows):
    labels = [rules.SINGLETON, *rules.RULE_LABELS, rules.HIGH_EARLIER]
    frame = spark.createDataFrame([(x,) for x in labels], "match_type string")
    assert [r[0] for r in frame.select(rules.tier()).collect()] == [
        "singleton", "exact", "hc", "lc", "other", "other", "hc",
    ]
