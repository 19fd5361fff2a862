"""Greedy couples: long chains of ever better pairs, and cells of every size."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import groups

PAIRS = (
    "task_id long, id_a long, id_b long, match_type string, fn_similarity_score double,"
    " ln_similarity_score double, adrs_similarity_score double"
)


def walk(rows):
    used, out = set(), set()
    for t, a, b, _, s, _, _ in sorted(rows, key=lambda r: (r[4] is None, -(r[4] or 0), r[1], r[2])):
        if (t, a) not in used and (t, b) not in used:
            used |= {(t, a), (t, b)}
            out.add((t, a, b))
    return out


def couples(spark, rows, cell):
    got = groups.matched_couples(spark.createDataFrame(rows, PAIRS), cell).collect()
    assert len(got) == len({(r.task_id, r.id_a, r.id_b) for r in got})
    return {(r.task_id, r.id_a, r.id_b) for r in got}


@pytest.mark.parametrize("cell", [7, 40, 100_000])
def test_random_pairs(spark, cell):
    rng = random.Random(cell)
    rows = []
    for task, n, scores in ((1, 40, 3), (2, 12, 10**6), (3, 2, 5)):
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
        rows += [(task, a, b, "x", rng.choice([None, float(rng.randrange(scores))]), 0.0, 0.0) for a, b in pairs]
    assert couples(spark, rows, cell) == walk(rows)


def test_a_long_chain_ends_in_few_rounds(spark, monkeypatch):
    """Each pair of neighbours is better than the one before, so the walk goes through all."""
    n = 100_000
    df = spark.range(n).select(
        F.lit(1).cast("long").alias("task_id"), F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"),
        F.lit("x").alias("match_type"), F.col("id").cast("double").alias("fn_similarity_score"),
        F.lit(0.0).alias("ln_similarity_score"), F.lit(0.0).alias("adrs_similarity_score"),
    )
    rounds = []
    plain = groups._settled
    monkeypatch.setattr(groups, "_settled", lambda *a: rounds.append(1) or plain(*a))
    got = sorted(r.id_a for r in groups.matched_couples(df, 5_000).collect())
    assert got == list(range(1, n, 2)) and len(rounds) <= 3
