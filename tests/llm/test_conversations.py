"""Conversation repair against a search over all edits in plain Python."""

import hashlib
import heapq
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from recordloom.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = re.compile(r"[\x20\x09-\x0D]+$")
GOOD = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        if how == 0:
            continue
        if how == 1:
            text = ""
        if how == 2:
            text = re.sub("[.!?]", "", text)
        if how == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if how == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired turns) by a search that takes states in order of cost and audit."""
    after = {
        ("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u",
    }
    full = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(kept)
        if (i, state) in done:
            continue
        done.add((i, state))
        for x in "ua":
            if (state, x) in after:
                heapq.heappush(heap, (cost + 2, audit + "I", i, x, (*kept, (full[x], ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, kept))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if (state, role[:1]) in after:
                to = after[state, role[:1]]
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, to, (*kept, (role, text))))
            for x in "ua":
                if (state, x) in after:
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, x, (*kept, (full[x], text))))


def brute(rows):
    out = []
    left = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted(
            (r for r in left if r[0] == conv),
            key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()),
        )
        seen, told = set(), []
        faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            body = WHITE.sub("", text)
            fault = None
            if not body:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif body[-1] not in ".!?":
                fault = "truncated"
            if fault:
                faults[fault] += 1
            seen.add((role, text))
            told.append((role, text, fault))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, kept = cheapest(told)
        assert GOOD.fullmatch("".join(r[:1] for r, _ in kept))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append(
            (conv, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
        )
    return sorted(out, key=repr)


def made_rows(seed, convs, turns):
    rng = random.Random(seed)
    texts = ["Hi.", "What? ", "no end", "", " \n", "Yes!", "é.", "x" * 300 + ".", None, "A: b\nc."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "-"]
    rows = []
    for c in range(convs):
        n = rng.randrange(0, turns)
        for t in range(n):
            plain = rng.random() < 0.6
            role = ("user", "assistant")[t % 2] if plain else rng.choice(roles)
            text = f"turn {t} of {c}." if plain else rng.choice(texts)
            turn = t + rng.randrange(3) if rng.random() < 0.9 else None
            rows += [(c if c else None, turn, role, text)] * rng.choice([1, 1, 1, 1, 3])
    return rows


def columns_of(df):
    df = df.withColumn("copies", F.lit("x")).withColumn("part", F.lit(1)).withColumn("body", F.lit(2))
    out = conversations.damage_and_repair(df)
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_short_conversations(spark, seed):
    rows = made_rows(seed, 60, 14)
    assert columns_of(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


@pytest.mark.parametrize("blank", [False, True])
def test_one_conversation_over_many_ranges(spark, blank, monkeypatch):
    monkeypatch.setattr(conversations, "RANGE_ROWS", 16)
    rows = [(7, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(300)]
    rows += [(8, t, "user", "only me.") for t in range(200)]
    rows += [(9, t, "user", f"me {t}") for t in range(100)]
    if blank:  # costs that never forget what comes later
        rows += [(7, t, "user", "") for t in range(300, 700)] + [(7, 800, "user", "Q?"), (8, 900, "user", "w.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert len({r.part for r in conversations.sorted_rows(df).select("part").collect()}) > 20
    assert columns_of(df) == brute(rows)


def test_odd_tables(spark):
    assert columns_of(spark.createDataFrame([], SCHEMA)) == []
    rows = [(None, None, None, None), (1, None, "user", "a."), (1, None, "user", "a.")]
    assert columns_of(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = columns_of(spark.createDataFrame([(gone, 0, "user", "x")], SCHEMA))
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_few_vectors():
    assert len(conversations.COSTS.vectors) < 64
    for kinds in ([1, 3, 5], [2, 4, 6, 8]):  # a few rows make all vectors alike, up to a constant
        runs = set(range(len(conversations.COSTS.vectors)))
        for kind in kinds * 4:
            runs = {int(conversations.COSTS.before[v, kind]) for v in runs}
        assert len(runs) == 1


@cache
def _strings():
    return ["s", "u", "a", "-"]


def test_costs_equal_a_plain_search():
    rng = random.Random(5)
    for _ in range(300):
        rows = [
            (rng.choice(_strings()), "t", rng.choice([None, None, "truncated", "blank"]))
            for _ in range(rng.randrange(7))
        ]
        kinds = [
            conversations.FORCED if f == "blank" else conversations.kind_of(r, f == "truncated")
            for r, _, f in rows
        ]
        after, steps = 0, []
        for kind in reversed(kinds):
            steps.append(after)
            after = int(conversations.COSTS.before[after, kind])
        audit, state = "", conversations.START
        for kind, v in zip(kinds, reversed(steps), strict=True):
            added, edit, state = conversations.COSTS.edits[v, kind, state]
            audit += "I" * len(added) + edit
        audit += "I" * len(conversations.COSTS.last[state])
        assert audit == cheapest(rows)[1]
