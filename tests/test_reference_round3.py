"""Tables replaced from their own rows, portable embeddings, the cost guard, hold-out reports."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.functions import vectors
from recordloom.functions.vectors import embed_letters
from recordloom.operators import groups, model, pairs
from recordloom.session import shuffle_width
from recordloom.sources import writers

ROWS = [(i, f"name {i % 3}") for i in range(20)]


def made(spark, table, path=None, partition_by=()):
    writers.overwrite(spark.createDataFrame(ROWS, "id long, lastname string"), table, partition_by, path)


def content(spark, table):
    return sorted(map(tuple, spark.table(table).select("id", "lastname").collect()))


@pytest.mark.parametrize("at_path", [False, True])
def test_a_table_is_rewritten_from_its_own_rows(spark, tmp_path, at_path):
    table, path = f"rewritten_{int(at_path)}", str(tmp_path / "rows") if at_path else None
    made(spark, table, path, ["lastname"])
    for _ in range(2):
        writers.rewrite(spark, table, lambda rows: rows.withColumn("id", F.col("id") + 100))
    assert content(spark, table) == [(i + 200, n) for i, n in ROWS]
    assert [c.name for c in spark.catalog.listColumns(table) if c.isPartition] == ["lastname"]
    assert not any(spark.catalog.tableExists(f"{table}{s}") for s in (writers._NEW, writers._OLD))
    writers.embed_table(spark, table, embed_letters, {"lastname": "v"})
    assert {len(r.v) for r in spark.table(table).collect()} == {26}


def test_a_failing_rewrite_leaves_the_table(spark):
    made(spark, "kept_rows")
    with pytest.raises(Exception):
        writers.rewrite(spark, "kept_rows", lambda rows: rows.withColumn("id", F.raise_error(F.lit("stop")).cast("long")))
    assert content(spark, "kept_rows") == ROWS
    writers.rewrite(spark, "kept_rows", lambda rows: rows.where("id < 5"))
    assert content(spark, "kept_rows") == ROWS[:5]


@pytest.mark.parametrize("step", [1, 2, 3])
def test_a_rewrite_cut_short_is_finished(spark, step, monkeypatch):
    """Stopped after the new rows are written, after the first renaming, after the second."""
    table = f"cut_short_{step}"
    made(spark, table)
    plain, done = spark.sql, []

    def stops(query, *args, **kwargs):
        if query.startswith("ALTER") or query.startswith(f"DROP TABLE {table}__before"):
            done.append(query)
            if len(done) == step:
                raise RuntimeError("the driver died")
        return plain(query, *args, **kwargs)

    monkeypatch.setattr(type(spark), "sql", lambda self, q, *a, **k: stops(q, *a, **k))
    with pytest.raises(RuntimeError):
        writers.rewrite(spark, table, lambda rows: rows.where("id < 7"))
    monkeypatch.undo()
    writers.finish_rewrite(spark, table)
    assert content(spark, table) == (ROWS if step == 1 else ROWS[:7])
    writers.rewrite(spark, table, lambda rows: rows.where("id < 3"))
    assert content(spark, table) == ROWS[:3]


def plain_ngrams(text, n=3, size=768):
    out = np.zeros(size)
    framed = f" {text.strip(' ').lower()} "
    for i in range(max(len(framed) - n + 1, 1) if len(framed) > 2 else 0):
        out[int(hashlib.md5(framed[i : i + n].encode()).hexdigest()[:8], 16) % size] += 1
    length = np.linalg.norm(out)
    return out / length if length else out


def test_portable_ngrams_equal_plain_python(spark):
    texts = ["Mira Lindqvist", "a", "", "  ", None, "日本語 テキスト", "aaaaaaaa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    df = df.withColumn("sparse", vectors.sparse_vector(vectors.ngram_buckets("t")))
    got = {r.id: r for r in vectors.portable_ngrams()(df, {"t": "v"}).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].v is None and got[i].sparse is None
            continue
        want = plain_ngrams(t)
        assert np.allclose(got[i].v, want, atol=1e-6)
        assert got[i].sparse["indices"] == np.flatnonzero(want).tolist()
        assert np.allclose(got[i].sparse["values"], want[want > 0])
    both = df.alias("a").join(df.alias("b"), F.expr("a.id < b.id")).select(
        F.col("a.id").alias("x"), F.col("b.id").alias("y"),
        vectors.sparse_dot_product("a.sparse", "b.sparse").alias("dot"),
    )
    for r in both.collect():
        a, b = texts[r.x], texts[r.y]
        assert (r.dot is None) == (a is None or b is None)
        if r.dot is not None:
            assert r.dot == pytest.approx(float(plain_ngrams(a) @ plain_ngrams(b)))


def test_all_pairs_are_guarded(spark, monkeypatch):
    df = spark.range(1000).withColumn("b", F.when(F.col("id") < 900, 1).otherwise(F.col("id")))
    assert pairs.pair_cost(df).pairs == 1000 * 999 // 2
    cost = pairs.pair_cost(df, ["b"], tile_rows=100)
    assert (cost.rows, cost.largest_block, cost.pairs, cost.cells, cost.largest_cell) == (
        1000, 900, 900 * 899 // 2, 81 + 100, 10_000,
    )

    def never(*args, **kwargs):
        raise AssertionError("pairs were formed")

    monkeypatch.setattr(pairs, "self_pairs", never)
    with pytest.raises(ValueError, match="499500 pairs"):
        pairs.all_pairs(df, most=400_000)
    monkeypatch.undo()
    assert pairs.all_pairs(df, most=499_500).count() == 499_500
    assert pairs.pair_cost(df.limit(0)) == pairs.Cost(0, 0, 0, 0, 0, 0)


def test_work_widens_and_narrows_a_shuffle(spark):
    df = spark.range(1)
    width = shuffle_width(df)
    assert shuffle_width(df, 10) <= max(width, df.sparkSession.sparkContext.defaultParallelism)
    assert shuffle_width(df, 10**12) == 50_000 > width


@pytest.mark.parametrize("n", [9_999, 10_000, 10_001])
def test_pair_lists_either_side_of_a_page(spark, n):
    df = spark.range(n).select(F.lit("x").alias("match_type"), F.lit(0).cast("long").alias("id_a"), F.col("id").alias("id_b"))
    got = {r.page: [tuple(p) for p in r.id_pairs] for r in groups.pair_lists(df).collect()}
    want = [(0, i) for i in range(n)]
    assert got == {p: want[p * 10_000 : (p + 1) * 10_000] for p in range(-(-n // 10_000))}


def test_hold_out_is_scored(spark):
    rows = [(str(i), i % 2, float(i % 2) + (i % 7) / 10, float(i % 5), None if i % 10 == 3 else 1.0) for i in range(200)]
    table = spark.createDataFrame(rows, "task_id string, response_final int, f double, g double, h double")
    trained = model.train(table, rounds=4)
    assert trained.filled == table.join(trained.holdout.select("task_id"), "task_id", "left_anti").where("h IS NULL").count() > 0
    found = model.evaluation(trained)
    scored = found.scored.collect()
    held = [str(i) for i in range(200) if int(hashlib.md5(f"17|{i}".encode()).hexdigest()[:8], 16) % 1000 >= 800]
    assert sorted(r.task_id for r in scored) == sorted(held)
    known = [r for r in scored if r.prediction is not None]
    right = sum(r["class"] == bool(r.response_final) for r in known) / len(known)
    assert found.overall.first().accuracy == pytest.approx(right) and right > 0.9
    assert sum(r["count"] for r in found.confusion.collect()) == len(known) < len(scored)
    unlabelled = table.withColumn("response_final", F.when(F.col("task_id") != "0", F.col("response_final")))
    if "0" not in held:
        with pytest.raises(ValueError, match="no response_final"):
            model.train(unlabelled)
