"""Burrows-Wheeler transforms of sets of strings, and merging them without comparing strings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Added to bytes, so that 0 is free for the ends of strings. Byte 255 is not in UTF-8.
END = np.uint8(0)
#: Symbols up to which the strings of several shards are transformed together.
TOGETHER = 1 << 16


@dataclass
class Transform:
    """The transform of a shard: symbol before each suffix, in sorted order of suffixes, the place
    of each suffix in the shard's text, and its symbols before the end. Ends of strings sort first,
    by string."""

    symbols: np.ndarray
    places: np.ndarray
    left: np.ndarray
    strings: int


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All strings, each followed by its end, as symbols; and where each begins."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    text = np.zeros(starts[-1], np.uint8)
    inside = np.ones(starts[-1], bool)
    inside[starts[1:] - 1] = False
    text[inside] = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
    return text, starts


def _order(values: np.ndarray) -> np.ndarray:
    """Stable order of values from 0 on, by 16 bits at a time: such sorts are linear."""
    order = np.argsort(values.astype(np.uint16), kind="stable")
    most = int(values.max(initial=0)) >> 16
    while most:
        values = values >> 16
        order = order[np.argsort(values.astype(np.uint16)[order], kind="stable")]
        most >>= 16
    return order


def _parted(head: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part intervals by the intervals of what follows.

    ``head`` is the place where each suffix's interval begins, and does not fall. Gives the order
    of suffixes, the heads in this order, and which suffixes are alone in their interval.
    """
    n = len(head)
    outer = np.ones(n, bool)
    outer[1:] = head[1:] != head[:-1]
    interval = np.cumsum(outer) - 1
    order = _order(following)
    order = order[_order(interval[order])]
    following = following[order]
    apart = outer.copy()
    apart[1:] |= following[1:] != following[:-1]
    count = np.arange(n, dtype=np.int32)
    begin, first = (np.maximum.accumulate(np.where(x, count, 0)) for x in (apart, outer))
    alone = apart.copy()
    alone[:-1] &= apart[1:]
    return order, head + begin - first, alone


def transform(strings: list[bytes]) -> Transform:
    """Sort the suffixes of one shard by doubling the length of the compared prefix.

    Only suffixes that share their prefix with another are sorted again.
    """
    text, starts = joined(strings)
    n = len(text)
    sizes = np.diff(starts)
    left = np.repeat(starts[1:], sizes) - np.arange(n)  # symbols up to the end, which counts
    pairs = text.astype(np.uint16) << 8
    pairs[:-1] |= text[1:]
    pairs[left == 1] = 0
    order, key = np.arange(n), np.zeros(n, np.uint64)
    for j in (6, 4, 2, 0):
        code = np.zeros(n, np.uint16)
        code[: max(0, n - j)] = pairs[j:]
        code[left <= j] = 0
        key |= code.astype(np.uint64) << np.uint64(48 - 8 * j)
        order = order[np.argsort(code[order], kind="stable")]
    width = 8
    key = key[order]
    new = left[order] <= width  # an end is like no other
    new[:1] = True
    new[1:] |= key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0)).astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = head
    alone = new.copy()
    alone[:-1] &= new[1:]
    places = np.flatnonzero(~alone)
    while len(places):
        some = order[places]
        now, heads, alone = _parted(rank[some], rank[some + width])
        some = some[now]
        order[places], rank[some] = some, heads
        places = places[~alone]
        width *= 2
    before = np.concatenate((text[-1:], text[:-1]))  # an end before each string's beginning
    return Transform(before[order], order, left[order] - 1, len(strings))


@dataclass
class Merged:
    """Suffixes of at least ``depth`` symbols in merged order, as numbers that count through the
    shards, and where intervals begin whose suffixes share their first ``depth`` symbols."""

    suffix: np.ndarray
    begins: np.ndarray


def merge(shards: list[Transform], depth: int) -> Merged:
    """Interleave the transforms until suffixes are in order of their first ``depth`` symbols.

    At first the shards follow each other, and suffixes are taken stably by their first symbols,
    which the transforms have without the texts. When suffixes are in order of ``known`` symbols,
    a round takes them by the intervals of the suffixes ``known`` symbols on: so they are in order
    of twice as many, and nothing is compared. Two neighbours of an interval part if what follows
    was apart already. A suffix that is alone in its interval has its final place, and one with
    an end among the symbols of a round is like no other: a round is only about the others.
    """
    base = np.concatenate(([0], np.cumsum([len(s.symbols) for s in shards])))
    n = base[-1]
    first = np.zeros(n, np.uint8)
    after = np.zeros(n, np.int32)  # the suffix after the first symbol of each
    for s, low, high in zip(shards, base[:-1], base[1:], strict=True):
        order = np.argsort(s.symbols, kind="stable")
        first[low:high] = s.symbols[order]
        after[low + s.strings : high] = order[s.strings :] + low
    left = np.concatenate([s.left for s in shards])
    known = min(4, depth)
    some = np.flatnonzero(left >= known)
    code, at = np.zeros(len(some), np.uint32), some
    for _ in range(known):
        code = (code << np.uint32(8)) | first[at]
        at = after[at]
    order = _order(code)
    some, code = some[order], code[order]
    new = np.ones(len(some) + 1, bool)
    new[1:-1] = code[1:] != code[:-1]
    head = np.maximum.accumulate(np.where(new[:-1], np.arange(len(some)), 0)).astype(np.int32)
    rank = np.zeros(n, np.int32)
    rank[some] = head
    some = some[~(new[:-1] & new[1:])]
    steps = [after]  # 1, 2, 4 ... symbols on
    while known < depth and len(some):
        step = min(known, depth - known)
        some = some[left[some] >= known + step]
        following = some
        for k in range(step.bit_length()):
            if k == len(steps):
                steps.append(steps[-1][steps[-1]])
            if step >> k & 1:
                following = steps[k][following]
        order, heads, alone = _parted(rank[some], rank[following])
        some = some[order]
        rank[some] = heads
        some = some[~alone]
        known += step
    suffix = np.flatnonzero(left >= depth)
    suffix = suffix[_order(rank[suffix])]
    begins = np.ones(len(suffix), bool)
    begins[1:] = rank[suffix[1:]] != rank[suffix[:-1]]
    return Merged(suffix, begins)


def _together(lengths: np.ndarray, shard_sizes: list[int]) -> list[int]:
    """Where the strings of neighbouring shards are cut: at ``TOGETHER`` symbols, or one shard."""
    symbols = np.concatenate(([0], np.cumsum(lengths + 1)))
    cuts, at = [0], 0
    for size in shard_sizes:
        if at > cuts[-1] and symbols[at + size] - symbols[cuts[-1]] > TOGETHER:
            cuts.append(at)
        at += size
    return [*cuts, at]


def least_owners(
    strings: list[bytes], owners: np.ndarray, depth: int, shard_sizes: list[int]
) -> tuple[np.ndarray, np.ndarray]:
    """For each string and each of its substrings of ``depth`` bytes, the least owner of any
    string that has the substring: all in one array, and where each string's begin.

    ``shard_sizes`` says how many strings, in order, make a shard. Each shard is transformed
    alone, or with its neighbours if they are small, and the transforms are merged; the
    intervals of the merged order are the repeated substrings.
    """
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.concatenate(([0], np.cumsum(np.maximum(0, lengths - depth + 1))))
    shards, string, offset = [], [], []
    cuts = _together(lengths, shard_sizes)
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        one = transform(strings[first:last])
        starts = np.concatenate(([0], np.cumsum(lengths[first:last] + 1)))
        inside = np.repeat(np.arange(last - first), np.diff(starts))[one.places]
        shards.append(one)
        string.append(inside + first)
        offset.append(one.places - starts[inside])
    merged = merge(shards, depth)
    string = np.concatenate(string)[merged.suffix]
    offset = np.concatenate(offset)[merged.suffix]
    out = np.empty(ends[-1], owners.dtype)
    if len(string):
        least = np.minimum.reduceat(owners[string], np.flatnonzero(merged.begins))
        out[ends[string] + offset] = least[np.cumsum(merged.begins) - 1]
    return out, ends
