"""Exact medians against Spark's own, over groups that one range holds and that many share."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators.medians import exact_medians


@pytest.mark.parametrize("width", [1, 8, 40])
def test_medians(spark, width):
    rng = random.Random(width)
    rows = [("hot", rng.choice([rng.random(), 0.5, -1.0]), rng.randrange(5)) for _ in range(5000)]
    rows += [(f"t{i % 50}", round(rng.random(), 1), None if i % 3 else i) for i in range(400)]
    rows += [("one", 2.0, 7), ("nothing", None, None), (None, 1.0, 1), (None, 2.0, 4), ("nan", 1e300, 1), ("nan", -1e300, 2)]
    df = spark.createDataFrame(rows, "task string, x double, y long").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        got = {r.task: (r.x, r.y) for r in exact_medians(df, ["task"], ["x", "y"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {r.task: (r.x, r.y) for r in df.groupBy("task").agg(F.median("x").alias("x"), F.median("y").alias("y")).collect()}
    assert want.pop("nothing") == (None, None)
    assert got == want


def test_hot_group_is_spread(spark):
    """The values of one group are sorted into many ranges, each in a task of its own."""
    from recordloom.operators import medians

    df = spark.range(200_000).select(F.lit("hot").alias("task"), F.rand(3).alias("x"))
    counted = df.select(
        "task", F.lit(0).alias("__metric"), F.col("x").alias("__value"), F.lit(1).cast("long").alias("__n")
    )
    found = medians._read_off(counted, ["task", "__metric"])
    sizes = [r["count"] for r in found.groupBy("__range").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 60_000
