"""Delimited files in splits against Python's csv reader."""

import csv
import random

import pytest
from pyspark.sql import types as T

from recordloom.sources import readers

AWKWARD = ['plain', 'a "quoted" word', "two\nlines", "three\n\nlines\n", "comma, here", " spaces ", "x" * 300, "é,日\n本", '"', "\n"]


@pytest.fixture
def small_splits(spark):
    """Splits of 64 KB, so that a file of a few hundred KB is many."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    for name, value in zip(names, ("65536", "0", "1"), strict=True):
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def written(path, rows, newline="\n"):
    with path.open("w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator=newline).writerows([["id", "text", "note"], *rows])
    return str(path)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_many_splits_equal_a_plain_reader(spark, tmp_path, small_splits, newline):
    rng = random.Random(8)
    rows = [[str(i), rng.choice(AWKWARD) + str(i), rng.choice(AWKWARD)] for i in range(6000)]
    rows[3000][1] = "line\n" * 40_000  # a value longer than several splits
    path = written(tmp_path / "big.csv", rows, newline)
    df = readers.read_delimited(spark, path, place="place")
    assert spark.read.text(path).rdd.getNumPartitions() > 5
    got = sorted(map(tuple, df.collect()), key=lambda r: r.place if hasattr(r, "place") else r[3])
    assert [list(r[:3]) for r in got] == rows


def test_several_files_and_headers(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    written(folder / "a.csv", [["1", "x", "y"]])
    written(folder / "b.csv", [["2", "u\nv", "w"]])
    got = sorted(map(tuple, readers.read_delimited(spark, str(folder)).collect()))
    assert got == [("1", "x", "y"), ("2", "u\nv", "w")]
    (folder / "c.csv").write_text("other,header\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        readers.read_delimited(spark, str(folder))


def test_odd_files(spark, tmp_path):
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    assert readers.read_delimited(spark, str(empty)).columns == []
    only = tmp_path / "only.csv"
    only.write_text("a,b\n")
    assert readers.read_delimited(spark, str(only)).count() == 0
    tall = tmp_path / "tall.csv"
    tall.write_text('"a\nb",a,A,,"q""r"\n1,2,3,4,5\n\n,"",x,y,z')
    df = readers.read_delimited(spark, str(tall))
    assert df.columns == ["a\nb", "a1", "A2", "_c3", 'q"r']
    assert sorted(map(tuple, df.collect()), key=repr) == [("1", "2", "3", "4", "5"), (None, "", "x", "y", "z")]
    broken = tmp_path / "broken.csv"
    broken.write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="not closed"):
        readers.read_delimited(spark, str(broken))


def test_bad_values_are_counted_or_refused(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("id,score,name\n1,0.5,a\nx,0.25,b\n3,high,c\n4,,d\n5,1.0\n")
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("name", T.StringType())]
    )
    got = readers.read_delimited(spark, str(path), schema, on_bad="column")
    assert sorted(map(tuple, got.select("id", "score", "name").collect()), key=repr) == [
        (1, 0.5, "a"), (3, None, "c"), (4, None, "d"), (5, 1.0, None), (None, 0.25, "b"),
    ]
    counts = {r.column: r.bad for r in readers.bad_value_counts(got).collect()}
    assert counts == {"id": 1, "score": 1, readers.WIDTH: 1}
    with pytest.raises(Exception, match="do not fit"):
        readers.read_delimited(spark, str(path), schema, on_bad="raise").collect()
    with pytest.raises(Exception, match="do not fit"):
        readers.read_delimited(spark, str(path), schema, on_bad="raise").count()
    good = tmp_path / "good.csv"
    good.write_text("id,score,name\n1,0.5,a\n")
    assert readers.read_delimited(spark, str(good), schema, on_bad="raise").count() == 1
