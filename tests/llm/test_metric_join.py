"""Metric join against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import metric_join

DOCS = "doc_id long, text string"


def brute(rows, similarity, width=3):
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        n = max(len(words) - width + 1, min(len(words), 1))
        sets.append((i, {tuple(words[k : k + width]) for k in range(n)}))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = 0
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= similarity * len(x | y):
                parent[root(a)] = root(b)
                linked += x != y
    least = {}
    for k, (i, x) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(x), least.get(root(k))) for k, (i, x) in enumerate(sets)), key=repr), linked


def near_copies(seed, groups, size, words, changes):
    """Copies of copies, a few words changed each time, so that groups are chains and clouds."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        texts = [[f"w{rng.randrange(10_000)}" for _ in range(rng.randrange(words // 2, words))]]
        for _ in range(rng.randrange(size)):
            text = list(rng.choice(texts))
            for _ in range(rng.randrange(changes)):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = [f"x{rng.randrange(10_000)}"]
            texts.append(text)
        rows += [" ".join(t) for t in texts]
    rng.shuffle(rows)
    return [(i * 7 + 1, t) for i, t in enumerate(rows)]


def found(df, **how):
    out = metric_join.similar_documents(df, **how).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr)


@pytest.mark.parametrize("seed, similarity", [(1, 90), (3, 65)])
def test_links(spark, seed, similarity, monkeypatch):
    monkeypatch.setattr(metric_join, "TILE", 4)
    monkeypatch.setattr(metric_join, "BUCKET", 2000)
    rows = near_copies(seed, 15, 40, 120, 4)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    want, linked = brute(rows, similarity)
    assert found(df, similarity=similarity) == want
    assert linked > 50


def test_regions_meet_only_in_windows(spark, monkeypatch):
    """One election leaves many pivots, so that links go across regions."""
    monkeypatch.setattr(metric_join, "ELECTIONS", 1)
    made = []
    plain = metric_join.window_links

    def counted(*args):
        out = plain(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(metric_join, "window_links", counted)
    for seed in range(2):
        rows = near_copies(10 + seed, 4, 120, 150, 7)
        want, _ = brute(rows, 88)
        assert found(spark.createDataFrame(rows, DOCS), similarity=88) == want
    assert sum(made) > 0


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, "null id"), (1, None), (2, ""), (3, " \n"), (4, "x"), (4, "x"), (5, "X"), (6, long)]
    rows += [(7, long + " more"), (8, "a b"), (9, "A\tb"), (10, "b a"), (11, "null id"), (None, "alone")]
    rows += [(12, long.replace("w5 ", "v ")), (4, "y y")]
    df = spark.createDataFrame(rows, DOCS)
    df = df.withColumns({n: F.lit(n) for n in ("id", "node", "n", "set_key", "prefix", "component")})
    got = found(df)
    want, _ = brute(rows, 90)
    assert got == want
    assert found(spark.createDataFrame([], DOCS)) == []
    assert found(spark.createDataFrame([(1, None), (2, "")], DOCS)) == [(1, 0, 1), (2, 0, 2)]
    with pytest.raises(ValueError):
        metric_join.similar_documents(df, similarity=50)


def test_first_shingles_are_shared():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 40, n))
        swaps = int(rng.integers(0, max(1, len(a) // 12) + 1))
        b = np.unique(np.concatenate((a[rng.permutation(len(a))[swaps:]], rng.integers(0, 1 << 40, swaps))))
        both = np.intersect1d(a, b).size
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            (i, c), (j, d) = (metric_join.least_shared(len(x), 80) for x in (a, b))
            assert np.intersect1d(a[:i], b[:j]).size >= min(c, d)


def test_common_passage_is_no_meeting(spark, monkeypatch):
    """Texts with one passage in common meet by what else they have, and links stay whole."""
    monkeypatch.setattr(metric_join, "COUNTED", 1)
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(90)]
    rows = [(i, f"{passage} {text}") for i, text in enumerate(own)]
    rows += [(100 + i, f"{passage} {text} end") for i, text in enumerate(own[:30])]
    made = []
    plain = metric_join.meetings

    def counted(*args):
        out = plain(*args)
        made.append(out.select("node", "pivot").distinct().count())
        return out

    monkeypatch.setattr(metric_join, "meetings", counted)
    want, linked = brute(rows, 90)
    assert found(spark.createDataFrame(rows, DOCS)) == want and linked == 30
    assert sum(made) < 10 * len(rows)
