"""Cosine index, rules driven by it, and the search for many queries, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.functions.vectors import hashed_ngrams
from recordloom.operators import cosine, rules, search

VECTORS = "block long, id long, name string, v array<double>"


def rows_of(kind, n=120, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if kind == "counts":
            v = rng.integers(0, 3, 12) * (rng.random(12) < 0.4)
        elif kind == "signed":
            v = np.round(rng.standard_normal(12), 2) * (rng.random(12) < 0.4)
        else:
            v = np.round(rng.standard_normal(6), 3) + 1
        out.append((i % 2, i, f"n{i % 7}", [float(x) for x in v]))
    out += [(0, 900, "null", None), (1, 901, "zero", [0.0] * len(v)), (None, 902, "none", out[0][3])]
    return out + [(0, 903, "same", out[0][3]), (0, None, "no id", out[0][3])]


def brute(rows, above):
    found = set()
    for block, i, _, v in rows:
        for other, j, _, w in rows:
            if None in (block, i, other, j, v, w) or block != other or i >= j:
                continue
            lengths = np.linalg.norm(v) * np.linalg.norm(w)
            if lengths and np.dot(v, w) / lengths > above:
                found.add((block, i, j))
    return found


@pytest.mark.parametrize("kind, above", [("counts", 0.9), ("counts", 0.6), ("signed", 0.7), ("dense", 0.95)])
def test_index_finds_all_pairs(spark, kind, above):
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, VECTORS)
    got = cosine.near_vectors(df, ["block"], "id", "v", "score", above).collect()
    assert {(r.block, r.id_a, r.id_b) for r in got} == brute(rows, above)
    assert len(got) == len({(r.id_a, r.id_b) for r in got}) and all(r.score > above for r in got)
    assert "name_a" in got[0].asDict()
    assert cosine.near_vectors(df.limit(0), ["block"], "id", "v", "score", above).count() == 0


def test_index_compares_few_pairs(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("aeiou") + rng.choice("bcdfghjklmnprstvwz") for _ in range(4)) for _ in range(1500)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    vectors = hashed_ngrams()(df, {"name": "v"})
    made, every = cosine.compared(vectors, [], "id", "v", 0.9)
    assert every == 1500 * 1499 // 2 and made < every / 20


RULES = {
    "a.name = b.name AND vector_cosine_similarity(a.v, b.v) > 0.5": (("name",), {"v": 0.5}, {}),
    "0.9 <= vector_cosine_similarity(b.v, a.v) AND a.block = b.block": (("block",), {"v": 0.9}, {}),
    "levenshtein(a.name, b.name) < 3 AND (a.name = b.name OR a.id = 1)": ((), {}, {"name": 2}),
    "editdistance(a.name, b.name) <= 1": ((), {}, {"name": 1}),
    "a.name = 'x' AND vector_cosine_similarity(a.v, a.v) > 0.9": ((), {}, {}),
    "NOT (a.name = b.name) AND vector_cosine_similarity(a.v, b.v) < 0.9": ((), {}, {}),
}


@pytest.mark.parametrize("rule", RULES)
def test_drivers_are_read_from_the_rule(spark, rule):
    found = rules.rule_drivers(spark, rule)
    assert (found.equal, found.cosine, found.edits) == RULES[rule]


@pytest.mark.parametrize(
    "rule",
    [
        "vector_cosine_similarity(a.v, b.v) > 0.8 AND a.id % 2 = b.id % 2",
        "levenshtein(a.name, b.name) < 2 AND a.id + 3 < b.id",
        "a.name = b.name AND vector_cosine_similarity(a.v, b.v) > 0.3",
        "a.id * 2 = b.id",
    ],
)
def test_driven_rules_equal_the_filtered_pairs(spark, rule):
    df = spark.createDataFrame([r for r in rows_of("counts", 80) if r[1] is not None], VECTORS)
    got = rules.rule_pairs(df, rule, ["block"])
    plain = df.alias("a").join(df.alias("b"), F.expr(f"a.block = b.block AND a.id < b.id AND ({rule})"))
    ids = ["a.block", F.col("a.id").alias("x"), F.col("b.id").alias("y"), "a.name", F.col("b.name").alias("z")]
    assert sorted(map(tuple, got.select(*ids).collect())) == sorted(map(tuple, plain.select(*ids).collect()))


@pytest.mark.parametrize("tiles", [(8192, 1024), (16, 8)])
def test_best_rows_of_many_queries(spark, tiles):
    rows = [r for r in rows_of("dense", 90) if r[1] is not None]
    df = spark.createDataFrame(rows, VECTORS)
    asked = df.where("id % 5 = 0")
    got = search.similar_rows_of_each(df, asked, "v", "id", 4, tile_rows=tiles[0], tile_queries=tiles[1])
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.id
    good = [(i, np.array(v) / np.linalg.norm(v)) for _, i, _, v in rows if v is not None and np.any(v)]
    for i, v in good:
        if i % 5 == 0:
            want = sorted(((-round(float(v @ w), 9), j) for j, w in good))[:4]
            assert found[i] == {k + 1: j for k, (_, j) in enumerate(want)}
    assert set(found) == {i for i, _ in good if i % 5 == 0}
    assert search.similar_rows_of_each(df.limit(0), asked, "v", "id").count() == 0
