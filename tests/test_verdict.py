"""Cases that once went wrong: quoted text in files, pushed filters, NULL ids."""

import pytest
from pyspark.sql import functions as F

from recordloom.functions import text
from recordloom.operators import rules, tiles
from recordloom.sources import readers


def test_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('a,b\n"x ""y"" z","one\ntwo"\nplain,"1,2"\n', encoding="utf-8")
    got = sorted(map(tuple, readers.read_delimited(spark, str(path)).collect()))
    assert got == [("plain", "1,2"), ('x "y" z', "one\ntwo")]


def test_recency_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "days")
    spark.sql("SELECT timestamp'2024-03-31 23:00:00' AS ts UNION ALL SELECT timestamp'2024-01-01 00:00:00'").write.parquet(path)
    kept = spark.read.parquet(path).where(text.is_recent("ts", F.lit("2024-03-31").cast("date")))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan" in plan and kept.count() == 1


def test_null_ids_have_no_pairs(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, None, [1.0, 0.0]), (1, 2, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "task long, id long, v array<double>")
    got = tiles.similar_pairs(frame, ["task"], "id", {"score": "v"})
    assert [(r.id_a, r.id_b) for r in got.collect()] == [(1, 2)]


@pytest.mark.parametrize(
    "predicate",
    [
        r"a.name = r'\\' OR reflect('java.util.UUID', 'randomUUID') = r'\\'",
        "a.id IN (TABLE secret)",
        "a.id IN (FROM secret)",
        "a.id IN (FROM secret |> WHERE true)",
        "EXISTS (VALUES 1)",
        "a.id = (SELECT 1)",
        "java_method('java.lang.System', 'exit', 1) = 1",
        "rand() < 0.5",
    ],
)
def test_unsafe_rules_are_refused(spark, predicate):
    frame = spark.createDataFrame([(1, 1, "x"), (1, 2, "x")], "task_id long, id long, name string")
    valid, why = rules.validate_rule(frame, predicate)
    assert not valid and why
    with pytest.raises(Exception):
        rules.rule_pairs(frame, predicate)


def test_plain_rules_are_run(spark):
    frame = spark.createDataFrame([(1, 1, "x"), (1, 2, "X")], "task_id long, id long, name string")
    rule = "lower(a.name) = lower(b.name) AND a.name NOT IN ('select', ';');"
    assert rules.validate_rule(frame, rule) == (True, None)
    assert rules.rule_pairs(frame, rule).count() == 1
