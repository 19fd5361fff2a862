import pytest
from pyspark.sql import functions as F, types as T

from recordloom.functions.vectors import embed_letters
from recordloom.operators import features, model, prepare, search
from recordloom.plans import matching
from recordloom.schemas import INPUT_RECORDS, RECORD_FILE, SCORED_TASKS
from recordloom.session import durable, shared_folder
from recordloom.sources import readers, writers

PEOPLE = """ID,FIRSTNAME,LASTNAME,ADDRESS,DOB,GENDER,COUNTRY,TASK_ID
1,Mira,Lindqvist,Oslo,20010203,F,Norway,11
2,Mira ,Lindqvist,Oslo,20010203,F,Norway,11
3,Mira K,Lindquist,Bergen,20010203,F,Norway,11
4,Jonas,Aas,Oslo,19900101,M,Norway,22
5,Jonas,B Aas,Oslo,,M,Norway,22
6,Solo,Alone,Oslo,19900101,M,Norway,33
"""


@pytest.fixture
def people_file(tmp_path):
    path = tmp_path / "people.csv"
    path.write_text(PEOPLE)
    return str(path)


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "shuffled.csv"
    path.write_text("lastname,FirstName,task_id,extra\nAas,Jonas ,22,z\n,Solo,x,z\n")
    got = readers.read_delimited(spark, str(path), RECORD_FILE)
    assert got.columns == ["firstname", "lastname", "task_id"]
    assert [tuple(r) for r in got.collect()] == [("Jonas ", "Aas", 22), ("Solo", None, None)]


def test_byte_order_mark_and_index_column_go(spark, tmp_path):
    path = tmp_path / "marked.csv"
    path.write_text("﻿,task_id,id_a\n0,11,1\n1,11,2\n", encoding="utf-8")
    got = readers.read_delimited(spark, str(path))
    assert got.columns == ["task_id", "id_a"] and got.count() == 2
    path.write_text("﻿task_id,id_a\n11,1\n", encoding="utf-8")
    assert readers.read_delimited(spark, str(path)).columns == ["task_id", "id_a"]


def test_other_separators(spark, tmp_path):
    path = tmp_path / "scores.txt"
    path.write_text(
        "FNI_FILE_ID|TASK_ID|RESPONSE_FINAL|PROBABILITY|CONFIDENCE_SCORE\n"
        "31|90|0|0.5|LOW\n31|91|1|0.8|MEDIUM\n32|92|0|0.0|HIGH\n32|93|1|1.0|HIGH\n"
    )
    got = readers.read_delimited(spark, str(path), SCORED_TASKS, "|")
    assert got.schema == SCORED_TASKS
    assert all(r[0] == r[1] for r in got.select(model.confidence_band(), "confidence_score").collect())


def test_synonyms(spark):
    frame = spark.createDataFrame([("a", "b", 1)], "`First Name` string, City string, order_id int")
    assert readers.rename_synonyms(frame).columns == ["firstname", "address", "id"]
    twice = spark.createDataFrame([("a", "b")], "fname string, firstname string")
    with pytest.raises(ValueError, match="fname"):
        readers.rename_synonyms(twice)


def test_upload_replaces_and_numbers(spark, people_file):
    for _ in range(2):
        rows = readers.read_delimited(spark, people_file, RECORD_FILE)
        writers.upload(rows.withColumn("id", F.col("id") * 10), "uploaded_people")
    got = spark.table("uploaded_people").orderBy("id").collect()
    assert [(r.id, r.source_id, r.firstname) for r in got][:2] == [(1, 10, "Mira"), (2, 20, "Mira ")]
    assert [r.id for r in got] == [1, 2, 3, 4, 5, 6]


def test_append_and_insert(spark):
    schema = T.StructType([f for f in INPUT_RECORDS if f.name in ("id", "firstname")])
    writers.create_table(spark, "typed_people", schema)
    assert spark.table("typed_people").schema == schema
    writers.append(spark.createDataFrame([("x", 1)], "firstname string, id long"), "typed_people")
    writers.insert_select(spark.createDataFrame([(2, "y")], "id long, firstname string"), "typed_people")
    assert sorted(map(tuple, spark.table("typed_people").collect())) == [(1, "x"), (2, "y")]


def test_added_columns_are_added_once(spark):
    kinds = {f.name: f.dataType for f in INPUT_RECORDS if f.name.endswith("_vector")}
    frame = spark.createDataFrame([(1,)], "id long").withColumn("FIRSTNAME_VECTOR", F.lit(None))
    once = writers.add_missing_columns(frame, kinds)
    assert once.columns == ["id", "FIRSTNAME_VECTOR", "lastname_vector", "address_vector"]
    assert writers.add_missing_columns(once, kinds).columns == once.columns


def test_partitioned_table_reads_one_task(spark, people_file):
    writers.overwrite(readers.read_delimited(spark, people_file, RECORD_FILE), "by_task", ["task_id"])
    one = spark.table("by_task").filter("task_id = 22")
    assert one.count() == 2
    assert "PartitionFilters: [isnotnull(task_id" in one._jdf.queryExecution().executedPlan().toString()


def test_checkpoints_go_to_the_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert durable(spark.range(3)).count() == 3


# -- whole plans -----------------------------------------------------------------------


def test_match_file(spark, people_file):
    result = matching.match_file(spark, people_file, "matched_people", embed_letters)
    pairs = {(r["id_a"], r["id_b"]): r["Match Type"] for r in result.pairs.collect()}
    assert set(pairs) == {(1, 2), (1, 3), (2, 3), (4, 5)}
    assert pairs[(1, 2)].startswith("hc-firstname") and pairs[(4, 5)] == "Fuzzy Match on Lastname"
    grouped = result.grouped.collect()
    assert sorted(r.id for r in grouped) == [1, 2, 3, 4, 5]
    assert {r.lastname for r in grouped if r.id == 5} == {"B Aas"}


def test_match_file_with_ngrams_and_options(spark, people_file):
    result = matching.match_file(
        spark, people_file, "matched_people_2", exclude_no_match=True, keep_unpaired=True
    )
    grouped = result.grouped.collect()
    assert sorted(r.id for r in grouped) == [1, 2, 3, 4, 5, 6]
    assert all(r.match_type != "No Match" for r in grouped)


# -- preparation, features, search -----------------------------------------------------


def test_mode_fill(spark, rows):
    frame = spark.createDataFrame(
        [(1, "x", 1.0), (1, "x", None), (1, None, 1.0), (2, "q", None), (2, "p", None), (2, None, None), (None, "z", 3.0)],
        "ID long, a string, b double",
    )
    assert rows(prepare.fill_with_mode(frame, "ID")) == sorted(
        [(1, "x", 1.0)] * 3 + [(2, "q", None), (2, "p", None), (2, "p", None)], key=repr
    )
    assert prepare.distinct_keys(frame, "ID").first()[0] == 3
    assert prepare.distinct_keys(frame, "ID", approximate=True).first()[0] == 3


MEMBERS = "task_id string, mcid string, first_name string, last_name string, middle_initial string, gender string, dob date, response_final long"


def members(spark, data):
    rows = [(t, m, f, l, "X", "F", None, y) for t, m, f, l, y in data]
    return spark.createDataFrame(rows, MEMBERS)


def test_one_pair_has_no_deviation_and_two_labels_two_rows(spark):
    frame = members(spark, [("1", "10", "Ann", "Lee", 1), ("1", "9", "Anne", "Lee", 0), ("2", "5", "Bo", "Ek", 1)])
    pairs = features.pair_features(features.member_keys(frame, embed_letters))
    assert [(r.mcid_a, r.mcid_b) for r in pairs.collect()] == [("10", "9")]
    got = features.task_features(pairs, frame).collect()
    assert len(got) == 2 and {r.response_final for r in got} == {0, 1}
    assert got[0].stddev_fn_ln_mi_jw == 0 and got[0].avg_fn_ln_mi_ed == 1
    assert len(got[0]) == 32


def test_duplicates_go_before_pairing(spark):
    frame = members(spark, [("1", "a", "Ann", "Lee", 1)] * 3 + [("1", "b", "Ann", "Lee", 1)])
    assert features.member_keys(frame, embed_letters).count() == 2


def test_a_missing_name_part_gives_missing_measures(spark):
    frame = members(spark, [("1", "a", None, "Lee", 1), ("1", "b", "Ann", "Lee", 1)])
    row = features.pair_features(features.member_keys(frame, embed_letters)).first()
    assert row.fn_ln_mi_jw is None and row.fn_ln_mi_smlrty_score is None and row.fn_ln_mi_jd == 1.0


def test_grid_has_sixty_columns(spark):
    frame = members(spark, [("1", "a", "Ann", "Lee", 1), ("1", "b", "Lee", "Ann", 1)])
    row = features.feature_grid(frame, embed_letters).first()
    assert len(row) == 61
    assert row.fn1_ln2_mean == pytest.approx(1) and row.fn1_ln2_jw_max == 1.0 and row.fn1_fn2_jd_min == 1.0


def test_search_embeds_the_question(spark):
    rows = embed_letters(spark.createDataFrame([(1, "app crash"), (2, "late parcel"), (3, "crash of app")], "id long, issue string"), {"issue": "v"})
    wanted = search.query_vector(spark, "app crash", embed_letters)
    got = search.similar_rows(rows, "v", wanted, "id", above=0.7, limit=2)
    assert [r.id for r in got.collect()] == [1, 3]
    assert "TakeOrderedAndProject" in got._jdf.queryExecution().executedPlan().toString()


# -- the classifier --------------------------------------------------------------------


@pytest.fixture(scope="module")
def task_rows(spark):
    rows = [(str(i), i % 2, float(i % 2) + (i % 7) / 10, float(i % 5), None if i == 3 else 1.0) for i in range(80)]
    return spark.createDataFrame(rows, "task_id string, response_final int, f double, g double, h double")


def test_training_repeats_and_scores_every_row(spark, task_rows):
    first, second = (model.train(task_rows, rounds=3) for _ in range(2))
    scored = model.unpack(model.predict(first, task_rows)).orderBy("task_id").collect()
    again = model.unpack(model.predict(second, task_rows.repartition(5))).orderBy("task_id").collect()
    assert [r.probability_true for r in scored] == [r.probability_true for r in again]
    assert len(scored) == 80 and sum(r.prediction is None for r in scored) == 1
    known = [r for r in scored if r.prediction is not None]
    assert all(r.probability_true + r.probability_false == pytest.approx(1) for r in known)
    assert all(r["class"] == (r.probability_true > 0.5) for r in known)
    assert sum(r["class"] == bool(r.response_final) for r in known) > 70


def test_importances_sum_to_one(spark, task_rows):
    shares = [r.score for r in model.feature_importance(model.train(task_rows, rounds=3), spark).collect()]
    assert len(shares) == 3 and sum(shares) == pytest.approx(1) and min(shares) >= 0


def test_split_keeps_tasks_together(task_rows):
    train, test = model.split_by_key(task_rows.union(task_rows))
    assert train.count() + test.count() == 160
    assert not {r.task_id for r in train.collect()} & {r.task_id for r in test.collect()}


def test_reports(spark):
    scored = spark.createDataFrame(
        [(1, 0.9, 1), (1, 0.4, 0), (0, 0.4, 0), (0, 0.1, 0)], "label int, p double, predicted int"
    )
    by_class = {r["class"]: r for r in model.class_metrics(scored, "label", "predicted").collect()}
    assert by_class[1].precision == 1 and by_class[1].recall == 0.5 and by_class[1].support == 2
    assert by_class[0].precision == pytest.approx(2 / 3) and by_class[0].recall == 1
    overall = model.global_metrics(scored, "label", "predicted", "p").first()
    assert overall.auc == pytest.approx(3.5 / 4) and overall.accuracy == 0.75
    levels = {r.threshold: r for r in model.threshold_metrics(scored, "label", "p", [0.0, 0.4, 0.95]).collect()}
    assert levels[0.0].recall == 1 and levels[0.0].false_positive_rate == 1
    assert levels[0.4].precision == pytest.approx(2 / 3) and levels[0.95].f1 == 0
    single = model.global_metrics(scored.filter("label = 1"), "label", "predicted", "p").first()
    assert single.auc is None
