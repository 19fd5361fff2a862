"""Repeated passages: bytes covered by strings that an earlier document has too.

Documents are dealt to shards, and the anchors of their strings to buckets. Shards ask the
buckets three times, each time about less: which anchors do several documents have; do all
runs with such an anchor look alike; and where they differ, which document has each string
first. Only the last question needs the strings themselves: the buckets transform them shard
by shard and merge the transforms. Where an anchor has many different runs, as a phrase that
many documents use, the strings themselves are dealt by their hashes, so no task has them all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bwt import least_owners
from .names import free_names
from .words import BYTE_VALUES, U64, mix, powers, text_bytes

#: Bytes of a repeated string, and of the anchors by which equal strings meet.
LENGTH, ANCHOR = 50, 24
#: Bytes of text that are hashed together; a longer text is cut, the pieces overlap.
BLOCK = 1 << 17
#: Bytes of text in a shard of documents, and for each bucket of anchors.
SHARD_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
#: Shards from which on shards and buckets grow with the root of the input, and how far: entries
#: are shards times buckets, which else would grow with the square of the input.
MANY_SHARDS, GROWN = 256, 4
#: Different runs with one anchor, in all shards, beyond which the anchor's strings are dealt by
#: hash; a shard with more than ``SHARD_CROWD`` of them says so instead of listing them.
CROWD, SHARD_CROWD = 4096, 64
#: Strings that are hashed together.
HASHED = 1 << 16
#: Stands for the part where a bucket is not dealt in parts.
WHOLE = -1


class Runs:
    """Runs of strings of ``length`` bytes that have the same anchor.

    The anchor of a string is the least hash of its substrings of ``anchor`` bytes, so equal
    strings have equal anchors. Run i lies in row ``row[i]`` from byte ``start[i]`` and holds
    ``count[i]`` strings, which cover ``count + length - 1`` bytes; ``content`` is a hash of
    these bytes. No run has more strings than places for an anchor.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
        parts = [
            _runs(data[low:high], pieces, length, anchor, low)
            for low, high, pieces in _blocks(offsets, length)
        ]
        empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
        columns = [np.concatenate(x) for x in zip(*(parts or [empty]), strict=True)]
        self.begin, self.row, self.count, self.anchor, self.content = columns
        self.start = self.begin - offsets[self.row]


def _blocks(offsets: np.ndarray, length: int):
    """(low, high, [(row, begin, end)]): stretches of text of about ``BLOCK`` bytes."""
    pieces, low = [], None
    for row in np.flatnonzero(np.diff(offsets) >= length).tolist():
        begin, end = int(offsets[row]), int(offsets[row + 1])
        while True:
            stop = min(end, begin + BLOCK)
            if pieces and stop - low > BLOCK:
                yield low, pieces[-1][2], pieces
                pieces = []
            if not pieces:
                low = begin
            pieces.append((row, begin, stop))
            if stop == end:
                break
            begin = stop - length + 1
    if pieces:
        yield low, pieces[-1][2], pieces


def _runs(data: np.ndarray, pieces: list, length: int, anchor: int, low: int):
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=sums[1:])
    least = (sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1]
    least = mix(least)
    places, size = length - anchor + 1, 1
    while size * 2 <= places:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if places > size:
        rest = places - size
        least = np.minimum(least[:-rest], least[rest:])
    rows = np.array([p[0] for p in pieces])
    begins = np.array([p[1] for p in pieces]) - low
    stops = np.array([p[2] for p in pieces]) - low - length + 1  # past the last string
    edge = np.zeros(len(least) + 1, bool)
    edge[begins] = True
    edge[stops] = True
    edge[1:-1] |= least[1:] != least[:-1]
    starts = np.flatnonzero(edge)
    starts, counts = starts[:-1], np.diff(starts)
    piece = np.searchsorted(begins, starts, "right") - 1
    inside = (piece >= 0) & (starts < stops[piece])
    starts, counts, piece = starts[inside], counts[inside], piece[inside]
    if (counts > places).any():
        cuts = -(-counts // places)
        which = np.repeat(np.arange(len(starts)), cuts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        starts, piece = starts[which] + nth * places, piece[which]
        counts = np.minimum(places, counts[which] - nth * places)
    ends = starts + counts + length - 1
    content = mix((sums[ends] - sums[starts]) * down[starts] + counts.astype(U64))
    return starts + low, rows[piece], counts, least[starts], content


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _array(packed: list, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind)


class Shard:
    """The runs of one shard's documents. A run's key has its bucket in the high half and 32
    bits of its anchor in the low half. Rows with a NULL id have no runs."""

    def __init__(self, table: pa.Table, buckets: int, how: tuple[str, str, int, int]):
        id_column, text_column, length, anchor = how[:4]
        ids = table.column(id_column).cast(pa.int64()).combine_chunks()
        self.data, self.offsets = text_bytes(table.column(text_column))
        self.runs = runs = Runs(self.data, self.offsets, length, anchor)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        bucket = runs.anchor % U64(buckets)
        self.key = ((bucket << U64(32)) | (runs.anchor >> U64(32))).astype(np.int64)
        self.usable = np.flatnonzero(known[runs.row])


def _keys(table: pa.Table, columns: str = "keys") -> np.ndarray:
    """The keys of all packed rows."""
    buckets = table.column("bucket").to_numpy()
    packed = table.column(columns).to_pylist()
    sizes = [len(p) // 4 for p in packed]
    return (np.repeat(buckets, sizes) << 32) | _array(packed, "<u4").astype(np.int64)


def _found(wanted: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are in ``sorted_keys``, and where."""
    place = np.searchsorted(sorted_keys, wanted)
    place[place == len(sorted_keys)] = 0
    hit = sorted_keys[place] == wanted if len(sorted_keys) else np.zeros(len(wanted), bool)
    return np.flatnonzero(hit), place[hit]


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the columns, the first one first, and where a new combination begins."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(new)


def _split(values: np.ndarray, begins: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.split(values, begins[1:])] if len(begins) else []


ASKED = "bucket long, shard long, keys binary, several binary"


def _ask(table: pa.Table, buckets: int, how: tuple) -> pa.Table:
    """The different anchors of a shard by bucket, and whether two of its documents have one."""
    shard = Shard(table, buckets, how)
    key, own = shard.key[shard.usable], shard.ids[shard.runs.row[shard.usable]]
    order, begins = _groups(key)
    key, own = key[order], own[order]
    if len(begins):
        several = np.minimum.reduceat(own, begins) != np.maximum.reduceat(own, begins)
    else:
        several = np.zeros(0, bool)
    key = key[begins]
    buckets_of, cuts = np.unique(key >> 32, return_index=True)
    return pa.table(
        {
            "bucket": buckets_of,
            "shard": np.full(len(cuts), table.column("shard")[0].as_py()),
            "keys": pa.array(_split(key.astype("<u4"), cuts), pa.binary()),
            "several": pa.array(_split(several.astype("u1"), cuts), pa.binary()),
        }
    )


FLAGGED = "shard long, bucket long, keys binary"


def _flag(table: pa.Table) -> pa.Table:
    """To each shard the anchors of a bucket that several documents have."""
    shards = table.column("shard").to_numpy()
    packed = table.column("keys").to_pylist()
    key = _array(packed, "<u4")
    shard = np.repeat(shards, [len(p) // 4 for p in packed])
    several = _array(table.column("several").to_pylist(), "u1")
    order, begins = _groups(key)
    sizes = np.diff(np.concatenate((begins, [len(key)])))
    repeated = (sizes > 1) | (np.maximum.reduceat(several[order], begins) > 0)
    keep = order[np.repeat(repeated, sizes)]
    keep = keep[np.argsort(shard[keep], kind="stable")]
    found, cuts = np.unique(shard[keep], return_index=True)
    return pa.table(
        {
            "shard": found,
            "bucket": np.full(len(found), table.column("bucket")[0].as_py()),
            "keys": pa.array(_split(key[keep], cuts), pa.binary()),
        }
    )


SEEN = "bucket long, shard long, keys binary, contents binary, ids binary, more binary, strings binary"


def _see(table: pa.Table, flags: pa.Table, buckets: int, how: tuple) -> pa.Table:
    """The different runs of a shard with a flagged anchor, the least id that has each, and
    whether a larger id has it too. An anchor with a crowd of runs is one entry, with the number
    of its strings; that of the others is 0."""
    if not table.num_rows or not flags.num_rows:
        return _arrow(SEEN).empty_table()
    shard = Shard(table, buckets, how)
    hit, _ = _found(shard.key[shard.usable], np.sort(_keys(flags)))
    use = shard.usable[hit]
    key, content = shard.key[use], shard.runs.content[use]
    own = shard.ids[shard.runs.row[use]]
    order, begins = _groups(key, content)
    own = own[order]
    if len(begins):
        least, most = np.minimum.reduceat(own, begins), np.maximum.reduceat(own, begins)
    else:
        least = most = own
    count = shard.runs.count[use][order]
    strings = np.add.reduceat(count, begins) if len(begins) else count
    key, content = key[order][begins], content[order][begins]
    first = np.flatnonzero(np.concatenate((key[:1] == key[:1], key[1:] != key[:-1])))
    many = np.diff(np.append(first, len(key)))
    crowded = many > how[4]
    if len(first):
        strings = np.repeat(np.where(crowded, np.add.reduceat(strings, first), 0), many)
    keep = ~np.repeat(crowded, many)
    keep[first] = True
    key, content, least, most, strings = (x[keep] for x in (key, content, least, most, strings))
    found, cuts = np.unique(key >> 32, return_index=True)
    return pa.table(
        {
            "bucket": found,
            "shard": np.full(len(found), table.column("shard")[0].as_py()),
            "keys": pa.array(_split(key.astype("<u4"), cuts), pa.binary()),
            "contents": pa.array(_split(content, cuts), pa.binary()),
            "ids": pa.array(_split(least, cuts), pa.binary()),
            "more": pa.array(_split((most > least).astype("u1"), cuts), pa.binary()),
            "strings": pa.array(_split(strings.astype("<i8"), cuts), pa.binary()),
        }
    )


class Seen:
    """What all shards have seen of one bucket, in order of anchor and content.

    ``dealt`` are entries of anchors whose strings are dealt by hash, and ``strings`` is no less
    than the number of strings of the entry's anchor.
    """

    def __init__(self, table: pa.Table, how: tuple):
        packed = table.column("keys").to_pylist()
        key = _array(packed, "<u4")
        content = _array(table.column("contents").to_pylist(), "<u8")
        shard = np.repeat(table.column("shard").to_numpy(), [len(p) // 4 for p in packed])
        ids = _array(table.column("ids").to_pylist(), "<i8")
        more = _array(table.column("more").to_pylist(), "u1")
        order = np.lexsort((ids, content, key))
        self.key, self.content, self.shard = key[order], content[order], shard[order]
        self.ids, self.more = ids[order], more[order] > 0
        n = len(order)
        anchor_begins = np.ones(n, bool)
        anchor_begins[1:] = self.key[1:] != self.key[:-1]
        run_begins = anchor_begins.copy()
        run_begins[1:] |= self.content[1:] != self.content[:-1]
        self.run = np.cumsum(run_begins) - 1
        self.first = np.flatnonzero(run_begins)  # with the least id of each run
        anchor = np.cumsum(anchor_begins) - 1
        runs_of_anchor = np.bincount(anchor[self.first], minlength=anchor[-1] + 1 if n else 0)
        strings = _array(table.column("strings").to_pylist(), "<i8")[order]
        places = how[2] - how[3] + 1  # the most strings of a run
        total = np.bincount(anchor, np.maximum(strings, places)).astype(np.int64)
        crowded = (runs_of_anchor > how[5]) | (np.bincount(anchor, strings > 0) > 0)
        self.dealt, self.strings = crowded[anchor], total[anchor]
        self.mixed = (runs_of_anchor[anchor] > 1) & ~self.dealt


TOLD = "shard long, bucket long, wanted binary, contents binary, dealt binary, folds binary"


def _tell(table: pa.Table, how: tuple, part_strings: int) -> pa.Table:
    """To each shard the runs whose strings it has to send, as it has their least id, and the
    anchors whose strings it has to deal, with the number of parts."""
    seen = Seen(table, how)
    send = seen.first[seen.mixed[seen.first]]
    new = np.ones(len(seen.key), bool)  # one entry for each shard and anchor
    by_shard = np.lexsort((seen.shard, seen.key))
    new[by_shard[1:]] = (seen.key[by_shard][1:] != seen.key[by_shard][:-1]) | (
        seen.shard[by_shard][1:] != seen.shard[by_shard][:-1]
    )
    folds = -(-seen.strings // part_strings)
    rows: dict[int, list] = {}
    for k, chosen in enumerate((send, np.flatnonzero(seen.dealt & new))):
        chosen = chosen[np.argsort(seen.shard[chosen], kind="stable")]
        found, cuts = np.unique(seen.shard[chosen], return_index=True)
        for s, own in zip(found.tolist(), np.split(chosen, cuts[1:]), strict=True) if len(found) else ():
            rows.setdefault(s, [b""] * 4)[2 * k : 2 * k + 2] = (
                seen.key[own].tobytes(),
                (seen.content, folds)[k][own].tobytes(),
            )
    columns = list(zip(*rows.values(), strict=True)) if rows else [()] * 4
    return pa.table(
        {
            "shard": pa.array(list(rows), pa.int64()),
            "bucket": pa.array([table.column("bucket")[0].as_py()] * len(rows), pa.int64()),
            **{n: pa.array(c, pa.binary()) for n, c in zip(_names(TOLD)[2:], columns, strict=True)},
        }
    )


STRINGS = (
    "bucket long, part long, shard long, keys binary, contents binary, sizes binary, strings binary"
)


def _send(table: pa.Table, told: pa.Table, shard: Shard, how: tuple) -> pa.Table:
    """The strings of the runs that a shard has been asked for."""
    length = how[2]
    wanted = _keys(told, "wanted")
    contents = _array(told.column("contents").to_pylist(), "<u8")
    order = np.lexsort((contents, wanted))
    wanted, contents = wanted[order], contents[order]
    use = shard.usable[np.isin(shard.key[shard.usable], wanted)]
    order, begins = _groups(shard.key[use], shard.runs.content[use])
    use = use[order[begins]]  # one of each, in the order of those that are wanted
    both = np.concatenate((shard.key[use], wanted))
    inner = np.concatenate((shard.runs.content[use], contents))
    asked = np.concatenate((np.zeros(len(use), bool), np.ones(len(wanted), bool)))
    order = np.lexsort((asked, inner, both))
    pair = np.flatnonzero(
        (both[order][1:] == both[order][:-1]) & (inner[order][1:] == inner[order][:-1])
    )
    use = use[order[pair]]
    key = shard.key[use]
    sizes = shard.runs.count[use] + length - 1
    begin = shard.runs.begin[use]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    flat = shard.data[np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])]
    found, cuts = np.unique(key >> 32, return_index=True)
    return pa.table(
        {
            "bucket": found,
            "part": np.full(len(found), WHOLE),
            "shard": np.full(len(found), table.column("shard")[0].as_py()),
            "keys": pa.array(_split(key.astype("<u4"), cuts), pa.binary()),
            "contents": pa.array(_split(shard.runs.content[use], cuts), pa.binary()),
            "sizes": pa.array(_split(sizes.astype("<u4"), cuts), pa.binary()),
            "strings": pa.array(_split(flat, ends[cuts]), pa.binary()),
        }
    )


ALIKE = "shard long, bucket long, keys binary, least binary"


def _alike(seen: Seen, bucket: int) -> pa.Table:
    """To each shard the least ids of runs that are alike wherever their anchor is."""
    least = seen.ids[seen.first][seen.run]
    use = np.flatnonzero(~seen.mixed & ~seen.dealt & ((least < seen.ids) | seen.more))
    use = use[np.argsort(seen.shard[use], kind="stable")]
    found, cuts = np.unique(seen.shard[use], return_index=True)
    return pa.table(
        {
            "shard": found,
            "bucket": np.full(len(found), bucket),
            "keys": pa.array(_split(seen.key[use], cuts), pa.binary()),
            "least": pa.array(_split(least[use], cuts), pa.binary()),
        }
    )


ANSWERS = "shard long, bucket long, keys binary, contents binary, parts binary, sizes binary, values binary"


def _answer(strings: pa.Table, seen: Seen, bucket: int, how: tuple) -> pa.Table:
    """To each shard, for the runs that differ, the least id of each of their strings, as
    stretches of equal ids.

    The strings that one shard has sent are transformed together, with those of its neighbours
    if they are few, then the transforms of all shards are merged.
    """
    if not strings.num_rows:
        return _arrow(ANSWERS).empty_table()
    length = how[2]
    rows = strings.sort_by("shard").to_pylist()
    key = _array([r["keys"] for r in rows], "<u4")
    content = _array([r["contents"] for r in rows], "<u8")
    sizes = _array([r["sizes"] for r in rows], "<u4").astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    flat = b"".join(r["strings"] for r in rows)
    bodies = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    sent = np.lexsort((content, key))  # the mixed runs of seen are in this order too
    mixed = seen.first[seen.mixed[seen.first]]
    owner = np.empty(len(bodies), np.int64)
    owner[sent] = seen.ids[mixed]
    flat, ends = least_owners(bodies, owner, length, [len(r["keys"]) // 4 for r in rows])
    many = np.diff(ends)[sent]
    stop = np.cumsum(many)
    starts = stop - many
    values = flat[np.arange(stop[-1]) + np.repeat(ends[sent] - starts, many)]
    lowest = np.minimum.reduceat(values, starts)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[starts] = True
    cuts = np.flatnonzero(new)
    value, size = values[cuts], np.diff(np.concatenate((cuts, [len(values)])))
    parts = np.add.reduceat(new.astype(np.int64), starts)
    part_ends = np.concatenate(([0], np.cumsum(parts)))
    number = np.full(seen.run[-1] + 1, -1)
    number[seen.run[mixed]] = np.arange(len(mixed))
    use = np.flatnonzero(seen.mixed)
    run = number[seen.run[use]]
    useful = (lowest[run] < seen.ids[use]) | seen.more[use]
    use, run = use[useful], run[useful]
    order = np.argsort(seen.shard[use], kind="stable")
    use, run = use[order], run[order]
    found, cuts = np.unique(seen.shard[use], return_index=True)
    ends = np.concatenate(([0], np.cumsum(parts[run])))
    at = np.repeat(part_ends[run] - ends[:-1], parts[run]) + np.arange(ends[-1])
    return pa.table(
        {
            "shard": found,
            "bucket": np.full(len(found), bucket),
            "keys": pa.array(_split(seen.key[use], cuts), pa.binary()),
            "contents": pa.array(_split(seen.content[use], cuts), pa.binary()),
            "parts": pa.array(_split(parts[run].astype("<u4"), cuts), pa.binary()),
            "sizes": pa.array(_split(size[at].astype("<u4"), ends[cuts]), pa.binary()),
            "values": pa.array(_split(value[at], ends[cuts]), pa.binary()),
        }
    )


PIECES = "bucket long, part long, shard long, hashes binary, ids binary, more binary, strings binary"


def _strings(shard: Shard, use: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, first byte and hash of every string of the runs ``use``."""
    count = shard.runs.count[use]
    run = np.repeat(use, count)
    within = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    begin = shard.runs.begin[run] + within
    factors = np.random.default_rng(length).integers(1, 1 << 63, length, dtype=np.uint64) | U64(1)
    hashes = np.zeros(len(run), U64)
    for low in range(0, len(run), HASHED):
        part = begin[low : low + HASHED]
        for j in range(length):
            hashes[low : low + HASHED] += BYTE_VALUES[shard.data[part + j]] * factors[j]
    return run, begin, mix(hashes)


def _deal(
    table: pa.Table, told: pa.Table, buckets: int, how: tuple, shard: Shard | None = None
) -> pa.Table:
    """The different strings of a shard whose anchor has a crowd of runs, in parts by hash, with
    the least id that has each and whether a larger id has it too. Their bucket is the anchor."""
    keys = _keys(told, "dealt")
    if not len(keys):
        return _arrow(PIECES).empty_table()
    order = np.argsort(keys)
    folds = _array(told.column("folds").to_pylist(), "<i8")[order]
    shard = shard or Shard(table, buckets, how)
    hit, place = _found(shard.key[shard.usable], keys[order])
    use = shard.usable[hit]
    run, begin, hashes = _strings(shard, use, how[2])
    part = (hashes % np.repeat(folds[place], shard.runs.count[use]).astype(U64)).astype(np.int64)
    own = shard.ids[shard.runs.row[run]]
    order, begins = _groups(shard.key[run], part, hashes)
    least, most = (f.reduceat(own[order], begins) for f in (np.minimum, np.maximum))
    one = order[begins]
    key, part, hashes = shard.key[run][one], part[one], hashes[one]
    body = np.lib.stride_tricks.sliding_window_view(shard.data, how[2])[begin[one]]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
    cuts = np.flatnonzero(new)
    return pa.table(
        {
            "bucket": key[cuts],
            "part": part[cuts],
            "shard": np.full(len(cuts), table.column("shard")[0].as_py()),
            "hashes": pa.array(_split(hashes, cuts), pa.binary()),
            "ids": pa.array(_split(least, cuts), pa.binary()),
            "more": pa.array(_split((most > least).astype("u1"), cuts), pa.binary()),
            "strings": pa.array(_split(body, cuts), pa.binary()),
        }
    )


SENT = (
    "bucket long, part long, shard long, keys binary, contents binary, sizes binary,"
    " hashes binary, ids binary, more binary, strings binary"
)


def _pass_on(table: pa.Table, told: pa.Table, buckets: int, how: tuple) -> pa.Table:
    """The strings of a shard that it has been asked for, and those that it has to deal."""
    if not table.num_rows or not told.num_rows:
        return _arrow(SENT).empty_table()
    shard = Shard(table, buckets, how)
    both = _send(table, told, shard, how), _deal(table, told, buckets, how, shard)
    return pa.concat_tables([_filled(t, SENT) for t in both])


SETTLED = "shard long, anchor long, hashes binary, values binary"


def _settle(table: pa.Table, length: int) -> pa.Table:
    """To each shard the least ids of the strings of one part that it does not know."""
    rows = table.sort_by("shard").to_pylist()
    sizes = [len(r["hashes"]) // 8 for r in rows]
    flat = b"".join(r["strings"] for r in rows)
    bodies = [flat[i : i + length] for i in range(0, len(flat), length)]
    ids = _array([r["ids"] for r in rows], "<i8")
    least, _ = least_owners(bodies, ids, length, sizes)
    news = (least < ids) | (_array([r["more"] for r in rows], "u1") > 0)
    hashes = _array([r["hashes"] for r in rows], "<u8")
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for r, low, high in zip(rows, cuts[:-1], cuts[1:], strict=True):
        some = low + np.flatnonzero(news[low:high])
        if len(some):
            out.append((r["shard"], r["bucket"], hashes[some].tobytes(), least[some].tobytes()))
    columns = zip(*out, strict=True) if out else [()] * 4
    return pa.table(
        {f.name: pa.array(c, f.type) for f, c in zip(_arrow(SETTLED), columns, strict=True)}
    )


NEWS = (
    "shard long, bucket long, keys binary, least binary, contents binary, parts binary,"
    " sizes binary, values binary, anchor long, hashes binary"
)


def _judge(sent: pa.Table, table: pa.Table, how: tuple) -> pa.Table:
    """To each shard what it does not know of a bucket's runs, or of one part of dealt strings."""
    if not table.num_rows:
        return _filled(_settle(sent, how[2]), NEWS)
    seen, bucket = Seen(table, how), table.column("bucket")[0].as_py()
    both = _alike(seen, bucket), _answer(sent, seen, bucket, how)
    return pa.concat_tables([_filled(t, NEWS) for t in both])


def _filled(table: pa.Table, schema: str) -> pa.Table:
    """``table`` with NULL for the columns of ``schema`` that it lacks."""
    fields = _arrow(schema)
    return pa.table(
        [table[f.name] if f.name in table.column_names else pa.nulls(len(table), f.type) for f in fields],
        schema=fields,
    )


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _spans(table: pa.Table, news: pa.Table, buckets: int, how: tuple) -> tuple[Shard, np.ndarray, np.ndarray]:
    """Covered stretches of a shard's documents: row, and begin and end in one number."""
    length = how[2]
    shard = Shard(table, buckets, how)
    runs = shard.runs
    settled = news.filter(pa.compute.is_valid(news.column("hashes")))
    told = news.filter(pa.compute.is_valid(news.column("least")))
    answers = news.filter(pa.compute.is_valid(news.column("parts")))
    key, least = _keys(told), _array(told.column("least").to_pylist(), "<i8")
    order = np.argsort(key)
    hit, place = _found(shard.key[shard.usable], key[order])
    use, low = shard.usable[hit], least[order][place]
    alike = low < shard.ids[runs.row[use]]
    use = use[alike]
    rows, begin = [runs.row[use]], [runs.start[use]]
    end = [runs.start[use] + runs.count[use] + length - 1]

    key = _keys(answers)
    content = _array(answers.column("contents").to_pylist(), "<u8")
    parts = _array(answers.column("parts").to_pylist(), "<u4").astype(np.int64)
    size = _array(answers.column("sizes").to_pylist(), "<u4").astype(np.int64)
    value = _array(answers.column("values").to_pylist(), "<i8")
    if len(key):
        ends = np.concatenate(([0], np.cumsum(parts)))
        before = np.concatenate(([0], np.cumsum(size)))
        within = before[:-1] - np.repeat(before[ends[:-1]], parts)
        # number the (key, content) pairs of runs and answers alike
        use = shard.usable[np.isin(shard.key[shard.usable], key)]
        both = np.concatenate((key, shard.key[use]))
        inner = np.concatenate((content, runs.content[use]))
        order, begins = _groups(both, inner)
        number = np.empty(len(both), np.int64)
        number[order] = np.repeat(
            np.arange(len(begins)), np.diff(np.concatenate((begins, [len(both)])))
        )
        entry = np.full(len(begins), -1)
        entry[number[: len(key)]] = np.arange(len(key))
        mine = entry[number[len(key) :]]
        use, mine = use[mine >= 0], mine[mine >= 0]
        many = parts[mine]
        run = np.repeat(use, many)
        stop = np.cumsum(many)
        at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(ends[mine] - (stop - many), many)
        cover = value[at] < shard.ids[runs.row[run]]
        run, at = run[cover], at[cover]
        rows.append(runs.row[run])
        begin.append(runs.start[run] + within[at])
        end.append(runs.start[run] + within[at] + size[at] + length - 1)
    if settled.num_rows:
        hashes = _array(settled.column("hashes").to_pylist(), "<u8")
        value = _array(settled.column("values").to_pylist(), "<i8")
        order = np.argsort(hashes)
        use = shard.usable[np.isin(shard.key[shard.usable], settled.column("anchor").to_numpy())]
        run, first, own = _strings(shard, use, length)
        hit, place = _found(own, hashes[order])
        hit = hit[value[order][place] < shard.ids[runs.row[run[hit]]]]
        rows.append(runs.row[run[hit]])
        begin.append(first[hit] - shard.offsets[rows[-1]])
        end.append(begin[-1] + length)
    return shard, np.concatenate(rows), (np.concatenate(begin) << 32) | np.concatenate(end)


def _cut(table: pa.Table, news: pa.Table, buckets: int, how: tuple) -> pa.Table:
    """The shard's rows, and what is left of their texts."""
    shard, rows, spans = _spans(table, news, buckets, how)
    order = np.argsort(rows, kind="stable")
    rows, spans = rows[order], spans[order]
    cuts = np.searchsorted(rows, np.arange(table.num_rows + 1))
    body = shard.data.tobytes()
    kept, bytes_in, removed, found = [], [], [], []
    for i, (low, high) in enumerate(zip(shard.offsets[:-1].tolist(), shard.offsets[1:].tolist(), strict=True)):
        gone = merged_spans(spans[cuts[i] : cuts[i + 1]])
        at, pieces = low, []
        for begin, end in gone.tolist():
            pieces.append(body[at : low + begin])
            at = low + end
        pieces.append(body[at:high])
        kept.append(b"".join(pieces))
        bytes_in.append(high - low)
        removed.append(high - low - len(kept[-1]))
        found.append([{"begin": b, "end": e} for b, e in gone.tolist()])
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    out = table.drop_columns(["shard"])
    for name, values, kind in (
        ("kept", kept, pa.binary()),
        ("n_bytes", bytes_in, pa.int64()),
        ("n_removed", removed, pa.int64()),
        ("spans", found, pa.list_(span)),
    ):
        out = out.append_column(name, pa.array(values, kind))
    return out


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Begin and end of maximal covered stretches, in order."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = np.sort(spans)
    begin, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    first = np.flatnonzero(new)
    return np.stack([begin[first], end[np.concatenate((first[1:] - 1, [len(end) - 1]))]], axis=1)


def _number(total: int, each: int) -> int:
    """Shards or buckets for ``total`` bytes of text, of ``each`` bytes or up to ``GROWN`` times."""
    grown = min(GROWN, max(1.0, math.sqrt(total / (each * MANY_SHARDS))))
    return max(1, int(total / (each * grown)))


def without_repeats(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    shard_bytes: int = SHARD_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    crowd: int = CROWD,
    shard_crowd: int = SHARD_CROWD,
) -> DataFrame:
    """``df`` with the columns kept (bytes that are left, as binary), n_bytes, n_removed and
    spans (removed stretches, begin and end in bytes).

    A byte goes if a string of ``length`` bytes covers it that also starts in a document with
    a smaller id. Strings are judged on the input, and overlap.

    A shard passes on one entry for each different anchor or run, so a passage that many
    documents share is one entry a shard. Its edges have other surroundings in each document, as
    has a frequent phrase: an anchor with more than ``crowd`` different runs, or ``shard_crowd``
    in one shard, is one entry a shard too, and its strings are dealt by their hashes to parts
    of about ``bucket_bytes``, after each shard has reduced them to one of each. All steps are
    one plan, and the texts are shuffled once, by shard.

    NULL text counts as empty. Texts shorter than ``length`` stay. Rows with the same id never
    remove from each other. A row with a NULL id stays whole and removes nothing. An empty
    table gives no rows. Columns of ``df`` named like the new ones, or shard, are replaced.
    """
    new = "kept binary, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>"
    names = [c for c in df.columns if c.lower() not in {*_names(new), "shard"}]
    total = df.agg(F.sum(F.octet_length(F.col(text_column).cast("string")))).first()[0] or 0
    shards, buckets = _number(total, shard_bytes), _number(total, bucket_bytes)
    how = (id_column, text_column, length, anchor, shard_crowd, crowd)
    part_strings = max(1, bucket_bytes // (length + 1))
    dealt = F.pmod(F.xxhash64(id_column, text_column), F.lit(shards).cast("long"))
    texts = df.select(*names, dealt.alias("shard"))

    def on_shard(other: DataFrame, step, schema) -> DataFrame:
        grouped = texts.groupBy("shard").cogroup(other.groupBy("shard"))
        return grouped.applyInArrow(lambda a, b: step(a, b, buckets, how), schema)

    asked = texts.groupBy("shard").applyInArrow(lambda t: _ask(t, buckets, how), ASKED)
    flags = asked.groupBy("bucket").applyInArrow(_flag, FLAGGED)
    seen = on_shard(flags, _see, SEEN).withColumn("part", F.lit(WHOLE).cast("long"))
    by_bucket = seen.groupBy("bucket", "part")
    told = by_bucket.applyInArrow(lambda t: _tell(t, how, part_strings), TOLD)
    sent = on_shard(told, _pass_on, SENT)
    news = (
        sent.groupBy("bucket", "part")
        .cogroup(by_bucket)
        .applyInArrow(lambda a, b: _judge(a, b, how), NEWS)
    )
    schema = T.StructType([f for f in texts.schema if f.name != "shard"])
    for field in T._parse_datatype_string(new):
        schema.add(field)
    return on_shard(news, _cut, schema)
