"""How the work of repeated passages grows: transforms of a bucket, entries, plan."""

import random

import numpy as np
import pytest

from recordloom.llm import bwt, repeats

from .test_operators import brute_repeats, docs_of


@pytest.mark.parametrize("depth, together", [(1, 40), (3, 40), (6, 200), (50, 5000), (50, 1 << 16)])
def test_least_owners_of_many_small_shards(monkeypatch, depth, together):
    rng = random.Random(depth)
    base = "".join(rng.choices("abé", k=400)).encode()
    strings, owners, sizes = [b"", b"a"], [3, 2], [1, 1]
    for _ in range(500):
        size = rng.randint(0, 3)
        sizes.append(size)
        for _ in range(size):
            cut = rng.randrange(330)
            strings.append(base[cut : cut + rng.randint(0, 76)])
            owners.append(rng.randint(1, 300))
    if depth == 6:  # a shard beyond the limit is transformed alone
        sizes.append(1)
        strings.append(base * 3)
        owners.append(7)
    least = {}
    for s, o in zip(strings, owners, strict=True):
        for k in range(len(s) - depth + 1):
            least[s[k : k + depth]] = min(o, least.get(s[k : k + depth], o))
    seen, whole = [], bwt.transform
    monkeypatch.setattr(bwt, "TOGETHER", together, raising=False)
    monkeypatch.setattr(bwt, "transform", lambda some: seen.append(len(some)) or whole(some))
    got, ends = bwt.least_owners(strings, np.array(owners), depth, sizes)
    want = [[least[s[k : k + depth]] for k in range(len(s) - depth + 1)] for s in strings]
    assert [got[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want
    symbols = sum(len(s) + 1 for s in strings)
    assert sum(seen) == len(strings)
    assert len(seen) <= 2 * symbols // together + 2 and len(seen) < 503  # 502 shards or more


def test_a_transform_sorts_all_suffixes():
    rng = random.Random(1)
    strings = ["".join(rng.choices("ab", k=rng.randint(0, 90))).encode() for _ in range(60)] + [b"a" * 300] * 3
    one = bwt.transform(strings)
    suffixes = [(s[k:], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1)]
    starts = np.concatenate(([0], np.cumsum([len(s) + 1 for s in strings])))
    # an end is less than any byte, and ends go by string
    want = [starts[i] + k for _, i, k in sorted(suffixes, key=lambda x: (x[0], x[1]))]
    assert one.places.tolist() == want
    text, _ = bwt.joined(strings)
    assert one.symbols.tolist() == [text[p - 1] for p in want]


def test_entries_grow_with_the_input(spark, monkeypatch):
    entries = lambda gb: repeats._number(gb << 30, 4 << 20) ** 2
    assert entries(1) == 256**2 and entries(10) <= 11 * entries(1)
    rng = random.Random(2)
    base = "".join(rng.choices("abcdefgh", k=300))
    rows = []
    for i in range(80):
        cut = rng.randrange(200)
        rows.append((i % 70, "".join(rng.choices("abcdefgh", k=40)) + base[cut : cut + rng.randint(20, 90)]))
    monkeypatch.setattr(repeats, "MANY_SHARDS", 2)
    got = repeats.without_repeats(docs_of(spark, rows), shard_bytes=500, bucket_bytes=700).collect()
    have = sorted(((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got), key=repr)
    assert have == brute_repeats(rows, 50)


def test_texts_are_hashed_four_times(spark):
    plan = repeats.without_repeats(docs_of(spark, [(1, "a" * 60)]))._jdf.queryExecution().analyzed().toString()
    # asking; seeing, which is read by two steps; passing on; cutting
    assert plan.count("FlatMapCoGroupsInArrow") == 5
