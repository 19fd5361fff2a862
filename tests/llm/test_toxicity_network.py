"""The network against plain loops, its slopes against differences, its thresholds, held-out labels."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.llm import toxicity as t
from recordloom.llm.words import text_bytes

TEXTS = ["one two three four", "one", "", "five six one two one two", "été déjà vu", "a b c d e f g h i j"]


def read(texts):
    return t.read_texts(*text_bytes(pa.array(texts, pa.string())))


def small_model(seed=1):
    model = t.new_model(seed)
    r = np.random.default_rng(seed)
    model.table = r.standard_normal(model.table.shape).astype(np.float32)
    model.bias = r.standard_normal(model.bias.shape).astype(np.float32) * 0.1
    model.out = r.standard_normal(model.out.shape).astype(np.float32)
    model.out_bias = 0.3
    return model


def test_pooling_equals_plain_loops():
    model, texts = small_model(), read(TEXTS)
    values, _, _ = model.pooled(texts)
    for i in range(len(TEXTS)):
        rows = texts.rows[texts.starts[i] : texts.starts[i + 1]]
        words = [sum(model.table[r] for r in row) for row in rows]
        for k, width in enumerate(t.WIDTHS):
            for f in range(t.FILTERS):
                responses = [
                    sum(float(words[p + j] @ model.filters[k][j][:, f]) for j in range(width) if p + j < len(words))
                    for p in range(len(words))
                ]
                own = k * t.FILTERS + f
                want = max(responses) + model.bias[own] if responses else 0.0
                assert values[i, own] == pytest.approx(want, abs=1e-4)
    logits = model.logits(texts)
    assert logits[2] == pytest.approx(model.out_bias)


def test_slopes_equal_differences():
    model, texts = small_model(2), read(TEXTS)
    truth, share = np.array([1, 0, 1, 0, 1, 0], np.float32), 0.4
    model.training = True
    found = t.slopes(model, texts, truth, share)
    arrays = [("out", model.out, found["out"]), ("bias", model.bias, found["bias"])]
    arrays += [((k, j), model.filters[k][j], found[k, j]) for k, w in enumerate(t.WIDTHS) for j in range(w)]
    used, of_table = found["table"]
    rng = np.random.default_rng(3)
    step, close, tried = 1e-2, 0, 0
    for _, values, slope in arrays:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in values.shape)
            tried, close = tried + 1, close + near(model, texts, truth, share, values, at, slope[at], step)
    for _ in range(20):
        row, column = int(rng.integers(0, len(used))), int(rng.integers(0, t.SIZE))
        at = int(used[row]), column
        tried, close = tried + 1, close + near(model, texts, truth, share, model.table, at, of_table[row, column], step)
    assert close >= 0.9 * tried  # a step may change which word responds most


def near(model, texts, truth, share, values, at, slope, step):
    before = values[at]
    losses = []
    for sign in (1, -1):
        values[at] = before + sign * step
        losses.append(t.log_loss(model, texts, truth, share))
    values[at] = before
    return abs((losses[0] - losses[1]) / (2 * step) - slope) < 0.02 * max(1.0, abs(slope))


def test_even_odds_are_where_classes_cross():
    rng = np.random.default_rng(1)
    truth = (rng.random(4000) < 0.3).astype(np.float32)
    logits = (rng.standard_normal(4000) + 2 * truth).astype(np.float32)
    # equal odds where 0.3 * density(x - 2) = 0.7 * density(x)
    assert t.even_odds(logits, truth) == pytest.approx(1 + np.log(0.7 / 0.3) / 2, abs=0.15)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_held_out_labels(spark):
    """Recall of at least 0.9 on the fold that is never learnt from, with few false alarms."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = t.scored(docs.select("doc_id", "text"), labels).where("held_out").join(labels, "doc_id")
    counts = {(r.toxic, r.predicted): r["count"] for r in held.groupBy("toxic", "predicted").count().collect()}
    caught, missed, false = counts.get((1, 1), 0), counts.get((1, 0), 0), counts.get((0, 1), 0)
    assert caught / (caught + missed) >= 0.9
    assert false <= 0.02 * (false + counts[0, 0])
