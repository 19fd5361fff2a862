"""Word and shingle hashes of whole Arrow string columns, without a loop over words.

The bytes of many texts are hashed at once: a word's hash is the difference of a running
polynomial sum at its two ends, so every step is one pass over an array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
#: Bytes of text hashed together. A longer text is hashed alone.
BLOCK_BYTES = 1 << 19

_random = np.random.default_rng(20_240_611)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_powers: dict[str, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters and digits; every byte of a character beyond ASCII counts as a letter.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** i`` and its inverse modulo 2**64 for i below ``n``."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1024)
        inverse = U64(pow(int(BASE), -1, 1 << 64))
        for key, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offset of each; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes, or one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


@dataclass
class Words:
    """Hashes of the words of several texts; ``starts[i]`` is the first word of text i."""

    hashes: np.ndarray
    starts: np.ndarray
    prefixes: tuple[np.ndarray, ...] = ()

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash for every run of ``width`` words, and the first of each text.

        A text of fewer words, but at least one, has one shingle of all its words.
        """
        counts = self.counts
        sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        steps = _steps(width)
        padded = np.concatenate((self.hashes, np.zeros(width, U64)))
        first = np.repeat(self.starts[:-1] - starts[:-1], sizes) + np.arange(starts[-1])
        short = np.repeat(np.where(counts < width, counts, width), sizes)
        total = np.zeros(len(first), U64)
        for j in range(width):
            piece = padded[first + j] * steps[j]
            if j:
                piece[short <= j] = 0
            total += piece
        return mix(total + short.astype(U64) * U64(0xD6E8FEB86659FD93)), starts


def _steps(width: int) -> np.ndarray:
    return np.random.default_rng(width).integers(1, 1 << 63, width, dtype=np.uint64) | U64(1)


def hash_words(
    data: np.ndarray,
    offsets: np.ndarray,
    is_word: np.ndarray | None = None,
    lower_latin: bool = False,
    prefixes: tuple[int, ...] = (),
) -> Words:
    """Words of the texts in ``data``, lower-cased, as 64-bit hashes.

    A word is a run of bytes outside [\\x20\\x09-\\x0D], or of ``is_word`` bytes if given.
    ``lower_latin`` also lower-cases the Latin-1 letters beyond ASCII. ``prefixes`` asks for
    hashes of the first so many bytes of each word, or of the word if it is shorter.
    """
    low = LOWER[data]
    if lower_latin and len(low) > 1:
        upper = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][upper] += 32
    inside = ~WHITE[low] if is_word is None else is_word[low]
    n = len(low)
    edge = np.zeros(n + 1, bool)  # a word cannot go on where another text begins
    edge[offsets] = True
    before = np.zeros(n, bool)
    if n:
        before[1:] = inside[:-1]
    begins = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    if n:
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUES[low] * up[:n], out=sums[1:])

    def between(to: np.ndarray, salt: int) -> np.ndarray:
        value = (sums[to] - sums[begins]) * down[begins]
        return mix(value + (to - begins).astype(U64) + U64(salt))

    parts = tuple(between(np.minimum(begins + k, ends), k << 32) for k in prefixes)
    return Words(between(ends, 0), np.searchsorted(begins, offsets), parts)
