import random

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from recordloom.functions import text, vectors
from recordloom.functions.text import _jaro_winkler_batch
from tests.brute import jaro_winkler

names = st.text(alphabet="abcdeéßñ 1", max_size=24)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: text.edit_distance(F.lit("J Quillfeather"), F.lit("Quillfeather")), 2),
        (lambda: text.edit_distance(F.lit("Ostwick"), F.lit("Bram")), 7),
        (lambda: text.jaccard_distance(F.lit("a,b"), F.lit("b,c")), 1 - 1 / 3),
        (lambda: text.jaccard_distance(F.lit(None).cast("string"), F.lit(None).cast("string")), 0.0),
        (lambda: text.jaccard_distance(F.lit(None).cast("string"), F.lit("a")), 1.0),
        (lambda: text.jaccard_distance(F.lit("Ann"), F.lit("Bob")), 1.0),
        (lambda: text.jaccard_distance(F.lit(""), F.lit("")), 0.0),
        (lambda: text.jaccard_distance(F.lit("abc"), F.lit("cab"), None), 0.0),
        (lambda: text.hamming_distance(F.lit("abc"), F.lit("abd")), 1),
        (lambda: text.hamming_distance(F.lit("abc"), F.lit("ab"), strict=False), None),
        (lambda: text.suppress_vowels(F.lit("Olive Underby")), "lv ndrby"),
        (lambda: text.name_key(F.lit("A"), F.lit("B"), F.lit(None).cast("string")), None),
        (lambda: text.joined_text(F.lit("A"), F.lit(None).cast("string")), None),
        (lambda: text.joined_text(F.lit("A"), F.lit("B")), "A B"),
        (lambda: text.known_dob(F.lit(None).cast("string")) == text.known_dob(F.lit("11110101")), True),
        (lambda: text.date_part_agreement("month", F.lit(None).cast("date"), F.lit(None).cast("date")), 0),
        (lambda: text.days_between(F.lit("2024-01-01").cast("date"), F.lit("2024-01-11").cast("date")), 10),
        (lambda: text.parse_ids(F.lit("2, 4")), [2, 4]),
        (lambda: text.parse_ids(F.lit("[2, 4]")), [2, 4]),
        (lambda: text.parse_ids(F.lit("[]")), []),
        (lambda: vectors.vector_sum(F.array(F.lit(1), F.lit(2)), F.array(F.lit(5)), F.array(F.lit(1), F.lit(1))), [7]),
        (lambda: vectors.cosine_similarity(F.array(F.lit(0.0)), F.array(F.lit(1.0))), None),
        (lambda: vectors.dot_product(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), 11.0),
    ],
)
def test_pinned(spark, column, expected):
    assert one(spark, column()) == expected


def test_hamming_of_unequal_lengths_fails(spark):
    with pytest.raises(Exception, match="differ in length"):
        one(spark, text.hamming_distance(F.concat(F.lit("ab"), F.col("id")), F.lit("ab")))


def test_recent_means_the_last_days(spark):
    days = spark.sql("SELECT * FROM VALUES (date'2024-01-01'), (date'2024-03-30'), (date'2024-04-02') AS t(d)")
    kept = days.filter(text.is_recent("d", F.lit("2024-03-31").cast("date")))
    assert [str(r.d) for r in kept.collect()] == ["2024-03-30"]


def test_jaro_winkler_pinned():
    got = _jaro_winkler_batch(
        pd.Series(["same", "abc", "MarlowBexley", None, "", "a"]),
        pd.Series(["same", "xyz", "MarnowBexley", "x", "a", None]),
    )
    assert got[0] == 1.0 and got[1] == 0.0 and got[4] == 0.0
    assert got[2] == pytest.approx(0.961111, abs=1e-6)
    assert got.isna().tolist() == [False, False, False, True, False, True]


@given(st.lists(st.tuples(names, names), min_size=1, max_size=30))
@settings(max_examples=150, deadline=None)
def test_jaro_winkler_equals_brute_force(pairs):
    s, t = zip(*pairs)
    got = _jaro_winkler_batch(pd.Series(s, dtype=object), pd.Series(t, dtype=object), chunk_cells=64)
    assert got.tolist() == pytest.approx([jaro_winkler(x, y) for x, y in pairs])
    assert all(0 <= x <= 1 for x in got)


def test_jaro_winkler_mixes_short_and_very_long_texts():
    rng = random.Random(3)
    long = "".join(rng.choices("abcdef", k=700))
    pairs = [("ab", "ba"), (long, long[:500] + "zz" + long[500:]), ("", ""), (long[::-1], "abc")]
    got = _jaro_winkler_batch(*(pd.Series(list(x), dtype=object) for x in zip(*pairs)))
    assert got.tolist() == pytest.approx([jaro_winkler(x, y) for x, y in pairs])


def test_hashed_ngrams(spark):
    frame = spark.createDataFrame([("Anna",), ("anna",), ("",), (None,), ("x",)], "t string")
    got = vectors.hashed_ngrams()(frame, {"t": "v"}).collect()
    by_text = {r["t"]: r["v"] for r in got}
    assert by_text[None] is None
    assert len(by_text["Anna"]) == 768 and by_text["Anna"] == by_text["anna"]
    assert sum(x * x for x in by_text["Anna"]) == pytest.approx(1, abs=1e-5)
    assert sum(x * x for x in by_text["x"]) == pytest.approx(1, abs=1e-5)
    assert not any(by_text[""])
