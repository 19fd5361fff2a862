"""Phrase mining against counts in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import collocations

DOCS = "doc_id long, text string, lang string"


def brute(rows, longest, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, counts = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least}
        held = set()
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p) and a >= often[p[i:j]]:
                        held.add(p[i:j])
        found = []
        for p, a in often.items():
            if len(p) > 1 and p not in held:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((" ".join(p), a, f[p[:k]], f[p[k:]], n[lang], score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(found[:top])]
    return sorted(out)


def made_rows():
    rng = random.Random(3)
    words = ["a", "B", "c", "dé", "e", "F\x00", "日本"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\r\n", ""]) for _ in range(60))
        rows.append((i, text, rng.choice(["x", "y", "", None])))
    rows += [(200, "a a a a a a a " * 20, "x"), (201, None, "x"), (202, "", None), (203, " \t.,", "z")]
    rows += [(204, "one two three four five six seven! " * 12, "x")] * 2
    return rows


@pytest.mark.parametrize("block", [1 << 22, 64])
def test_phrases(spark, block, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKET", 1 << 9)
    rows = made_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    df = df.withColumns({n: F.lit(7) for n in ("block", "words", "id", "n", "rank", "phrase")})
    got = collocations.collocations(df, least=8, top=40, block=block).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 8, 40)
    assert any(r.phrase == "one two three four five" for r in got)


def test_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    few = spark.createDataFrame([(1, None, None), (2, "a b", "x")], DOCS)
    assert collocations.collocations(few).count() == 0


def test_parts_end_with_pieces():
    data = np.frombuffer(b"aa bb.cc dd,eeeeeeeeeeeeeeeeeeee ff.g", np.uint8)
    parts = [bytes(p) for p in collocations.slices(data, 8)]
    assert b"".join(parts) == bytes(data)
    assert all(p[-1:] in b".," for p in parts[:-1]) and len(parts) >= 4


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [(2, big, 10**15, [big, big], [big + 1, big])]
    df = spark.createDataFrame(rows, "k int, f long, n long, heads array<long>, tails array<long>")
    got = df.withColumn("heads", F.array(F.lit(big + 7), F.lit(big))).select(
        collocations._lowest_cut(5).alias("c")
    )
    assert got.first()["c"]["score"] == 1000 * big * 10**15 // ((big + 7) * (big + 1))
