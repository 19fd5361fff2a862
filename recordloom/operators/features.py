"""Supervised matching: derived keys, pair features, and statistics per task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..functions.vectors import Embedder
from ..session import durable
from .medians import exact_medians
from .tiles import similar_pairs

LABEL = "response_final"

PAIR_METRICS = (
    "fn_ln_mi_smlrty_score",
    "fn_ln_mi_jw",
    "fn_ln_mi_sprs_vwl_jw",
    "fn_ln_mi_jd",
    "fn_ln_mi_ed",
    "fn_ln_mi_sprs_vwl_ed",
)


def member_keys(members: DataFrame, embed: Embedder) -> DataFrame:
    """Distinct derived rows: run-together name, its vector, and its vowel-less form.

    Duplicates go before the embedding, so only short columns are compared.
    """
    key = text.name_key("first_name", "last_name", "middle_initial")
    distinct = members.select(
        "task_id", "mcid", key.alias("fn_ln_mi"), "gender", "dob", LABEL
    ).distinct()
    embedded = embed(distinct, {"fn_ln_mi": "fn_ln_mi_vector"})
    return embedded.withColumn("fn_ln_mi_sprsd_vwl", text.suppress_vowels("fn_ln_mi")).select(
        "task_id", "mcid", "fn_ln_mi", "fn_ln_mi_vector", "fn_ln_mi_sprsd_vwl", "gender", "dob", LABEL
    )


def pair_features(keys: DataFrame, **tiling) -> DataFrame:
    """Comparison of all pairs of a task, ``mcid_a < mcid_b`` as text."""
    sided = keys.select(
        "task_id", "mcid", "fn_ln_mi", "fn_ln_mi_vector", "fn_ln_mi_sprsd_vwl", "dob"
    )
    pairs = similar_pairs(
        sided, ["task_id"], "mcid", {"fn_ln_mi_smlrty_score": "fn_ln_mi_vector"}, **tiling
    )
    flags = {
        f"{part}_match": text.date_part_agreement(part, "dob_a", "dob_b")
        for part in ("month", "year", "day")
    }
    name = ("fn_ln_mi_a", "fn_ln_mi_b")
    bare = ("fn_ln_mi_sprsd_vwl_a", "fn_ln_mi_sprsd_vwl_b")
    return pairs.select(
        "task_id",
        "mcid_a",
        "mcid_b",
        *name,
        "fn_ln_mi_smlrty_score",
        text.jaro_winkler_similarity(*name).alias("fn_ln_mi_jw"),
        text.jaccard_distance(*name).alias("fn_ln_mi_jd"),
        text.edit_distance(*name).alias("fn_ln_mi_ed"),
        text.edit_distance(*bare).alias("fn_ln_mi_sprs_vwl_ed"),
        text.jaro_winkler_similarity(*bare).alias("fn_ln_mi_sprs_vwl_jw"),
        "dob_a",
        "dob_b",
        *[flag.alias(n) for n, flag in flags.items()],
        sum(flags.values(), F.lit(0)).alias("total_match_score"),
    )


def statistics(metric: str) -> dict[str, Column]:
    """Statistics of a metric that partial aggregation sums up; a single row deviates by 0."""
    return {
        "avg": F.avg(metric),
        "max": F.max(metric),
        "min": F.min(metric),
        "stddev": F.coalesce(F.stddev_samp(metric), F.lit(0.0)),
    }


def task_labels(members: DataFrame) -> DataFrame:
    return members.select("task_id", LABEL).distinct()


def task_statistics(
    pairs: DataFrame,
    metrics: Sequence[str] = PAIR_METRICS,
    approximate_median: bool = False,
) -> DataFrame:
    """One row per task with five statistics of every metric.

    Medians are exact, and no task of the cluster holds the values of a task_id (see
    ``medians``). ``approximate_median`` keeps a sketch of fixed size instead, in one pass.
    """
    found = {f"{s}_{m}": c for m in metrics for s, c in statistics(m).items()}
    names = [f"{s}_{m}" for m in metrics for s in ("avg", "median", "max", "min", "stddev")]
    if approximate_median:
        found |= {f"median_{m}": F.percentile_approx(m, 0.5, 10_000) for m in metrics}
        return pairs.groupBy("task_id").agg(*[found[n].alias(n) for n in names])
    pairs = durable(pairs.select("task_id", *metrics))  # summed up, and sorted by value
    summed = pairs.groupBy("task_id").agg(*[c.alias(n) for n, c in found.items()])
    middle = exact_medians(pairs, ["task_id"], metrics)
    middle = middle.withColumnsRenamed({m: f"median_{m}" for m in metrics})
    return summed.join(middle, "task_id", "left").select("task_id", *names)


def task_features(pairs: DataFrame, members: DataFrame, **options) -> DataFrame:
    """Statistics per task with the task's label.

    A task with two labels gives two rows of equal statistics. Pairs are summed up before
    the join, so the labels meet one row per task and not one per pair.
    """
    return task_statistics(pairs, **options).join(task_labels(members), "task_id")


def label_conflicts(members: DataFrame) -> DataFrame:
    """Tasks carrying more than one label."""
    return (
        members.groupBy("task_id")
        .agg(F.countDistinct(LABEL).alias("labels"), F.count("*").alias("records"))
        .filter("labels > 1")
    )


# The name comparisons of the feature grid.
GRID_PAIRS = {
    "fn1_fn2": ("first_name", "first_name"),
    "fn1_ln2": ("first_name", "last_name"),
    "fn2_ln1": ("last_name", "first_name"),
    "ln1_ln2": ("last_name", "last_name"),
    "fn_ln_mi1_fn_ln_mi2": ("fn_ln_mi", "fn_ln_mi"),
}


def _grid_statistics(metric: str) -> dict[str, Column]:
    return {
        "mean": F.avg(metric),
        "min": F.min(metric),
        "max": F.max(metric),
        "sd": F.coalesce(F.stddev_samp(metric), F.lit(0.0)),
    }


def feature_grid(
    members: DataFrame,
    embed: Embedder,
    comparisons: Mapping[str, tuple[str, str]] = GRID_PAIRS,
    **tiling,
) -> DataFrame:
    """Per task, mean/min/max/sd of cosine, Jaccard and Jaro-Winkler for every comparison.

    Columns are ``<comparison>[_jd|_jw]_<statistic>``, 60 with the default comparisons.
    """
    key = text.name_key("first_name", "last_name", "middle_initial")
    fields = sorted({c for pair in comparisons.values() for c in pair})
    rows = members.withColumn("fn_ln_mi", key).select("task_id", "mcid", *fields).distinct()
    rows = embed(rows, {c: f"{c}_vector" for c in fields})
    cosines = {n: (f"{left}_vector", f"{right}_vector") for n, (left, right) in comparisons.items()}
    pairs = similar_pairs(rows, ["task_id"], "mcid", cosines, **tiling)
    for name, (left, right) in comparisons.items():
        a, b = f"{left}_a", f"{right}_b"
        pairs = pairs.withColumns(
            {
                f"{name}_jd": text.jaccard_distance(a, b),
                f"{name}_jw": text.jaro_winkler_similarity(a, b),
            }
        )
    order = [f"{c}{m}" for m, c in product(("", "_jd", "_jw"), comparisons)]
    return pairs.groupBy("task_id").agg(
        *[
            c.alias(f"{metric}_{statistic}")
            for metric in order
            for statistic, c in _grid_statistics(metric).items()
        ]
    )
