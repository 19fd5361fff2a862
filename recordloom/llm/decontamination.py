"""Benchmark passages in documents: SimHash windows, Hamming blocks, rare shingles, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .names import free_names
from .shipping import received, sent
from .words import ALNUM, U64, Words, blocks, hash_words, mix, text_bytes

WIDTH = 5
SIMILARITY = 0.8
#: Fingerprints that differ in so many bits at most are candidates.
RADIUS = 3
#: Documents have a window at every so many words; items have one at every word.
STRIDE = 4
#: Words of items in one broadcast index; further items get an index and a pass of their own.
MAX_WORDS = 1_000_000
#: Longest window: eight bits count its words.
LONGEST = 250

#: Low bits of shingles by which most of a document's are told to be in no item.
HINT = U64((1 << 22) - 1)

HIGH = U64(0x8080808080808080)
GATHER = U64(0x0102040810204080)


def lanes(words: np.ndarray) -> np.ndarray:
    """Running sums of the words' 64 bits, eight bits a sum, in eight rows of numbers.

    Differences of two columns are exact sums over a window of at most 255 words.
    """
    bits = np.unpackbits(mix(words).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.ascontiguousarray(bits).view(U64)
    out = np.zeros((8, len(words) + 1), U64)
    for k in range(8):
        np.cumsum(packed[:, k], out=out[k, 1:])
    return out


def fingerprints(sums: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the windows of ``width`` words at ``first``: bits set in most words."""
    out = np.zeros(len(first), U64)
    bias = U64(int.from_bytes(bytes([127 - width // 2]) * 8, "little"))
    for k in range(8):
        column = sums[k]
        count = column[first + width] - column[first]
        majority = ((count + bias) & HIGH) >> U64(7)
        out |= ((majority * GATHER) >> U64(56)) << U64(8 * k)
    return out


def window_words(n: int, width: int, similarity: float, stride: int) -> tuple[int, int]:
    """Words of an item's windows, and the stride of windows in documents.

    An aligned copy keeps at least ``2 s / (1 + s)`` of an item's shingles. Changed words
    inside cost ``width - 1`` shingles or more each, so the kept ones form a bounded number
    of runs, and the longest run is ``run`` words that the copy leaves as they are. Windows
    are so short that one of each ``stride`` of them in a document lies within the run.
    """
    shingles = max(1, n - width + 1)
    lost = int(shingles * (1 - similarity) / (1 + similarity) + 1e-9)
    runs = lost // max(1, width - 1) + 1
    run = -(-(shingles - lost) // runs) + min(n, width) - 1
    stride = max(1, min(stride, run // 3))
    return min(run - stride + 1, LONGEST), stride


def runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every run of exactly ``size`` words, and the first of each text."""
    found, starts = words.shingles(size)
    short = np.repeat(words.counts < size, np.diff(starts))
    kept = np.concatenate(([0], np.cumsum(~short)))
    return found[~short], kept[starts]


def best_window(found: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[int, float]:
    """First word and weighted similarity of the best of all windows of an item's size.

    ``found`` are the shingles of a text, ``keys`` the item's in order and ``counts`` how often
    each is in the item. Windows that reach beyond the text are cut at its ends. Of the
    occurrences of a shingle in a window the last ones count, as many as the item has: so an
    occurrence counts for the windows that hold it, but not that many later ones.
    """
    size = int(counts.sum())
    slot = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    hit = np.flatnonzero(keys[slot] == found)
    if not len(hit):
        return 0, 0.0
    order = np.argsort(slot[hit], kind="stable")
    place, of = hit[order], slot[hit][order]
    later = np.arange(len(place)) + counts[of]
    inside = np.minimum(later, len(place) - 1)
    stays = (later < len(place)) & (of[inside] == of)
    last = np.where(stays, np.minimum(place, place[inside] - size), place)
    # windows begin at 1 - size and later; ``both`` is what they share with the item
    steps = np.bincount(place, minlength=len(found) + size)
    steps[: len(found) + size] -= np.bincount(last + size, minlength=len(found) + size)
    both = np.cumsum(steps)[: len(found) + size - 1]
    begin = np.arange(1 - size, len(found))
    held = np.minimum(begin + size, len(found)) - np.maximum(begin, 0)
    got = both / (size + held - both)
    best = int(np.argmax(got))
    return max(0, int(begin[best])), float(got[best])


@dataclass
class Size:
    """Fingerprints of all item windows of one size, with a table for each block of bits."""

    width: int
    stride: int
    prints: np.ndarray
    item: np.ndarray
    place: np.ndarray
    tables: list[tuple[int, int, np.ndarray, np.ndarray]]


class Index:
    """Item windows by size and by block of their fingerprints.

    A fingerprint within the radius of another equals it in at least one of radius + 1
    blocks, so looking up each block finds every one.
    """

    def __init__(self, texts: list[str], width: int, similarity: float, radius: int, stride: int):
        self.width, self.similarity, self.radius = width, similarity, radius
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        words = hash_words(data, offsets, ALNUM, lower_latin=True)
        self.counts = words.counts
        groups: dict[tuple[int, int], list] = {}
        sums = lanes(words.hashes)
        for i, n in enumerate(self.counts):
            start = words.starts[i]
            if n:
                size = window_words(int(n), width, similarity, stride)
                places = np.arange(n - size[0] + 1)
                found = fingerprints(sums, start + places, size[0])
                groups.setdefault(size, []).append((found, np.full(len(places), i), places))
        self._post(words)
        self.sizes = []
        cuts = np.linspace(0, 64, radius + 2).astype(int)
        for (words_in, step), parts in sorted(groups.items()):
            prints, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            tables = []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                values = _block(prints, low, high)
                order = np.argsort(values, kind="stable")
                starts = np.searchsorted(values[order], np.arange((1 << (high - low)) + 1))
                tables.append((int(low), int(high), starts.astype(np.int32), order))
            self.sizes.append(Size(words_in, step, prints, item, place, tables))

    def _post(self, words: Words) -> None:
        """Shingles of the items, and the items listed under their rarest shingles.

        A window of the similarity shares at least that part of the item's shingles, so one
        of any ``size - least + 1`` of them is in the window.
        """
        self.shingles: list[tuple[int, np.ndarray, np.ndarray] | None] = [None] * len(self.counts)
        self.posted = {}
        for size in sorted({min(int(n), self.width) for n in self.counts if n}):
            flat, starts = runs(words, size)
            members = np.flatnonzero(np.minimum(self.counts, self.width) == size)
            for i in members:
                keys, n = np.unique(flat[starts[i] : starts[i + 1]], return_counts=True)
                self.shingles[i] = (size, keys, n)
            every, spread = np.unique(
                np.concatenate([self.shingles[i][1] for i in members]), return_counts=True
            )
            keys, items = [], []
            for i in members:
                _, own, n = self.shingles[i]
                order = np.argsort(spread[np.searchsorted(every, own)], kind="stable")
                least = int(np.ceil(n.sum() * self.similarity - 1e-9))
                before = np.cumsum(n[order]) - n[order]
                rare = own[order[before <= n.sum() - least]]
                keys.append(rare)
                items.append(np.full(len(rare), i))
            keys, items = np.concatenate(keys), np.concatenate(items)
            order = np.argsort(keys, kind="stable")
            keys, begins = np.unique(keys[order], return_index=True)
            hint = np.zeros(int(HINT) + 1, bool)
            hint[(keys & HINT).astype(np.int64)] = True
            self.posted[size] = (keys, np.append(begins, len(items)), items[order], hint)

    def candidates(self, sums: np.ndarray, counts: np.ndarray, starts: np.ndarray):
        """(text, item, first word of the item's copy in the text) for windows near an item's run."""
        for size in self.sizes:
            fits = np.maximum(0, (counts - size.width) // size.stride + 1)
            ends = np.cumsum(fits)
            if not len(ends) or not ends[-1]:
                continue
            text = np.repeat(np.arange(len(counts)), fits)
            place = (np.arange(ends[-1]) - np.repeat(ends - fits, fits)) * size.stride
            prints = fingerprints(sums, starts[text] + place, size.width)
            hits = []
            for low, high, begins, order in size.tables:
                value = _block(prints, low, high)
                n = begins[value + 1] - begins[value]
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                n = n[some]
                window = np.repeat(some, n)
                slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                entry = order[np.repeat(begins[value[some]], n) + slot]
                apart = np.bitwise_count(prints[window] ^ size.prints[entry])
                near = apart <= self.radius
                hits.append((window[near], entry[near]))
            if hits:
                window, entry = (np.concatenate(x) for x in zip(*hits, strict=True))
                yield text[window], size.item[entry], place[window] - size.place[entry]

    def sharing(self, parts: dict[int, tuple[np.ndarray, np.ndarray]]):
        """(text, item) where the text has one of the item's posted shingles.

        Every text with a window of the wanted similarity is among them, however the item's
        parts are ordered there.
        """
        for size, (keys, begins, items, hint) in self.posted.items():
            found, starts = parts[size]
            some = np.flatnonzero(hint[(found & HINT).astype(np.int64)])
            slot = np.minimum(np.searchsorted(keys, found[some]), len(keys) - 1)
            same = keys[slot] == found[some]
            some, slot = some[same], slot[same]
            n = begins[slot + 1] - begins[slot]
            entry = np.repeat(begins[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            text = np.searchsorted(starts, np.repeat(some, n), "right") - 1
            yield text, items[entry]

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, float]]:
        """(text, item, first word, similarity) of the best window of each matching item."""
        data, offsets = text_bytes(column)
        for first, last in blocks(offsets):
            base = offsets[first]
            words = hash_words(
                data[base : offsets[last]], offsets[first : last + 1] - base, ALNUM, True
            )
            parts = {size: runs(words, size) for size in self.posted}
            found = [x[:2] for x in self.candidates(lanes(words.hashes), words.counts, words.starts[:-1])]
            found += self.sharing(parts)
            if not found:
                continue
            tested = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
            for text, item in tested.T.tolist():
                size, keys, n = self.shingles[item]
                flat, starts = parts[size]
                place, got = best_window(flat[starts[text] : starts[text + 1]], keys, n)
                if got >= self.similarity:
                    yield first + text, item, place, got


def _block(prints: np.ndarray, low: int, high: int) -> np.ndarray:
    return ((prints >> U64(low)) & U64((1 << (high - low)) - 1)).astype(np.int64)


def item_blocks(benchmark: DataFrame, item_column: str, text_column: str, max_words: int):
    """Lists of (item id, text) of at most ``max_words`` words, one item at least.

    The benchmark is read to the driver as a stream, a block at a time.
    """
    block, size = [], 0
    for row in benchmark.select(item_column, text_column).toLocalIterator():
        text = row[1] or ""
        words = len(text) // 2 + 1
        if block and size + words > max_words:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += words
    if block:
        yield block


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    width: int = WIDTH,
    least: float = SIMILARITY,
    radius: int = RADIUS,
    stride: int = STRIDE,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """Rows (id, item_id, first_word, similarity): documents with a passage of the benchmark.
    If both ids have the same name, the item's is called ``item_<name>``.

    Words are lower-cased runs of letters and digits. A passage matches an item if the window
    of the item's size there has a weighted shingle similarity of ``least`` or more; the best
    window of each document row and item is returned, the first if several are equal. A
    document shorter than the item is compared as it is.

    SimHash windows of runs name documents and items, and so do the rarest shingles of an
    item, of which every matching window has one; then every window of the item's size is
    compared, whatever the order of its parts.

    Items and documents without words (NULL, empty) match nothing. Repeated rows give
    repeated results; NULL ids are carried along. Empty tables give no rows. Texts are not
    shuffled: every block of items is sent to the tasks that read documents. A text of any
    length is compared whole, in one task.
    """
    kinds = dict(documents.dtypes)[id_column], dict(benchmark.dtypes)[item_column]
    item_name = item_column if item_column.lower() != id_column.lower() else f"item_{item_column}"
    schema = f"{id_column} {kinds[0]}, {item_name} {kinds[1]}, first_word long, similarity double"
    read = documents.select(id_column, F.col(text_column).cast("string"))
    out = None
    for block in item_blocks(benchmark, item_column, item_text_column, max_words):
        index = Index([t for _, t in block], width, least, radius, stride)
        ids = [i for i, _ in block]
        target = to_arrow_type(benchmark.schema[item_column].dataType)
        shipped = sent(documents.sparkSession, (index, ids))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, target=target) -> Iterator[pa.RecordBatch]:
            index, ids = received(shipped)
            for batch in batches:
                found = list(index.matches(batch.column(1)))
                text, item, place, got = zip(*found, strict=True) if found else ((),) * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(text, pa.int64())),
                        pa.array([ids[i] for i in item]).cast(target),
                        pa.array(place, pa.int64()),
                        pa.array(got, pa.float64()),
                    ],
                    [id_column, item_name, "first_word", "similarity"],
                )

        part = read.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return documents.sparkSession.createDataFrame([], schema) if out is None else out


def without_contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    **how,
) -> DataFrame:
    """The rows of ``documents`` whose id has no match, with all their columns.

    Rows with a NULL id are judged by their text instead of their id.
    """
    own = free_names(documents, "own_key")[0]
    key = F.coalesce(
        F.col(id_column).cast("string"), F.concat(F.lit("text "), F.md5(F.col(text_column)))
    )
    marked = documents.withColumn(own, key)
    found = contaminated(marked, benchmark, own, text_column, **how)
    return marked.join(found.select(own).distinct(), own, "left_anti").drop(own)
