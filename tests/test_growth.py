"""Work that has to grow with what is computed, and not with every row or byte that leads to it."""

from pyspark.sql import functions as F

from recordloom.functions import vectors
from recordloom.operators import pairs, tiles
from recordloom.plans.matching import name_similarity
from recordloom.schemas import RECORD_VECTORS


def test_vectors_are_made_of_folded_records_only(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def letters(text):
        made.add(1)
        return [float(text.count(c)) for c in "abcdefgh"]

    def embed(df, columns):
        return df.withColumns({vector: letters(text) for text, vector in columns.items()})

    names = ["abc", "cab", "fgh", "bca"]
    rows = [(i, names[i % 4], "abd", "h") for i in range(2000)]
    records = spark.createDataFrame(rows, "id long, firstname string, lastname string, address string")
    found = name_similarity(records, embed).where("similarity_score > 0.99").collect()
    same = ["abc", "cab", "bca"]
    assert {(r.first_record, r.second_record): r.pairs for r in found} == {
        (a, b): 500 * 500 for a in same for b in same if a != b
    }
    assert made.value <= 20 * len(names) * len(RECORD_VECTORS)


def test_ngrams_are_hashed_once_and_spread(spark):
    df = spark.createDataFrame([(i, f"name {i}") for i in range(50)], "id long, t string").coalesce(1)
    embedded = vectors.portable_ngrams()(df, {"t": "v"})
    assert embedded.rdd.getNumPartitions() > 1
    assert embedded._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert [len(r.v) for r in embedded.collect()] == [768] * 50


def test_rows_of_large_blocks_are_not_brought_together(spark):
    rows = [(i % 2, i, [1.0, float(i)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "task_id long, id long, v array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        found = tiles.similar_pairs(frame, ["task_id"], "id", {"s": "v"}, tile_rows=5)
        joined = pairs.self_pairs(frame, tile_rows=5)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (found, joined)]
        counts = found.count(), joined.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert counts == (2 * 190, 2 * 190)
    assert [plan.count("BroadcastHashJoin") for plan in plans] == [1, 2]
    assert "SortMergeJoin" not in plans[0]


def test_rows_of_one_id_are_dealt_to_tiles(spark):
    data = [(7, 0 if i % 2 else i, [1.0, float(i)]) for i in range(400)]
    frame = spark.createDataFrame(data, "task_id long, id long, v array<double>").repartition(4)
    found = pairs.measure(frame, ["task_id"])
    placed = tiles._placed(frame, ["task_id"], "id", ["v"], 40, found, 4)
    largest = max(r["count"] for r in placed.where("__low = __high").groupBy("__low").count().collect())
    assert largest < 80
    got = tiles.similar_pairs(frame, ["task_id"], "id", {"s": "v"}, tile_rows=40)
    want = sorted((min(a, b), max(a, b)) for k, (_, a, _) in enumerate(data) for _, b, _ in data[:k] if a != b)
    assert sorted((r.id_a, r.id_b) for r in got.select("id_a", "id_b").collect()) == want
