"""Text, date and conditional columns used by the match rules and features."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# A NULL birth date or gender is compared as this text.
DOB_SENTINEL = "11110101"
GENDER_SENTINEL = "UNK"

VOWELS = "aeiouAEIOU"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def edit_distance(a, b) -> Column:
    return F.levenshtein(col(a), col(b))


def within_edits(a, b, limit: int) -> Column:
    """True when at most ``limit`` edits apart; stops counting beyond the limit."""
    return F.levenshtein(col(a), col(b), limit) >= 0


def jaccard_distance(a, b, separator: str | None = ",") -> Column:
    """1 - |A & B| / |A | B| over the separated elements.

    Two NULLs are equal (0), one NULL is fully different (1). ``separator=None``
    compares the sets of characters.
    """
    a, b = col(a), col(b)
    pattern = "" if separator is None else re.escape(separator)
    left, right = F.split(a, pattern), F.split(b, pattern)
    common = F.size(F.array_intersect(left, right))
    union = F.size(F.array_union(left, right))
    return (
        F.when(a.isNull() & b.isNull(), F.lit(0.0))
        .when(a.isNull() | b.isNull(), F.lit(1.0))
        .otherwise(F.lit(1.0) - common.cast("double") / union)
    )


def hamming_distance(a, b, strict: bool = True) -> Column:
    """Number of differing positions. Unequal lengths fail, or give NULL if not strict."""
    a, b = col(a), col(b)
    differs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    total = F.aggregate(differs, F.lit(0), lambda acc, x: acc + x)
    unequal = (
        F.raise_error(F.lit("the two texts differ in length")).cast("int")
        if strict
        else F.lit(None).cast("int")
    )
    return F.when(F.length(a) == F.length(b), total).when(
        F.length(a) != F.length(b), unequal
    )


def suppress_vowels(s) -> Column:
    return F.translate(col(s), VOWELS, "")


def name_key(*parts) -> Column:
    """First, last and middle name run together; NULL if any part is NULL."""
    return F.concat(*[col(p) for p in parts])


def joined_text(*parts, separator: str = " ") -> Column:
    """Parts joined by the separator; unlike ``concat_ws``, NULL if any part is NULL."""
    spaced = []
    for i, part in enumerate(parts):
        if i:
            spaced.append(F.lit(separator))
        spaced.append(col(part))
    return F.concat(*spaced)


def known_dob(c) -> Column:
    return F.coalesce(col(c), F.lit(DOB_SENTINEL))


def known_gender(c) -> Column:
    return F.coalesce(col(c), F.lit(GENDER_SENTINEL))


def date_part_agreement(part: str, a, b) -> Column:
    """1 when the named part (``month``, ``year``, ``day``) is equal, else 0 (also for NULL)."""
    extract = {"month": F.month, "year": F.year, "day": F.dayofmonth}[part]
    return F.when(extract(col(a)) == extract(col(b)), 1).otherwise(0)


def days_between(start, end) -> Column:
    """Days from ``start`` to ``end``."""
    return F.datediff(col(end), col(start))


def is_recent(date, today, days: int = 90) -> Column:
    """Date lies within the last ``days`` days before ``today``, this day included.

    A range on the column itself, which reaches the scan.
    """
    return (col(date) >= F.date_sub(col(today), days - 1)) & (col(date) < F.date_add(col(today), 1))


def parse_ids(text) -> Column:
    """``'2,4'`` or ``'[2, 4]'`` as an array of longs."""
    bare = F.regexp_replace(col(text), r"[\[\]\s]", "")
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(bare, ","), lambda x: x.cast("bigint"))
    )


def _code_points(strings: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    width = max(int(lengths.max(initial=0)), 1)
    return strings.astype(f"U{width}").view(np.uint32).reshape(len(strings), width)


def _jaro_winkler_rows(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Similarity of row-aligned strings, all rows advanced together.

    Every step compares one position of ``s`` with the whole of ``t`` for all rows, so
    the Python loop runs over positions and never over rows.
    """
    len_s = np.fromiter(map(len, s), np.int64, len(s))
    len_t = np.fromiter(map(len, t), np.int64, len(t))
    cs, ct = _code_points(s, len_s), _code_points(t, len_t)
    window = np.maximum(len_s, len_t) // 2 - 1
    pos_t = np.arange(ct.shape[1])
    free = pos_t < len_t[:, None]
    taken_s = np.zeros(cs.shape, bool)
    taken_t = np.zeros(ct.shape, bool)
    rows = np.arange(len(s))
    for i in range(cs.shape[1]):
        near = np.abs(pos_t - i) <= window[:, None]
        hit = free & near & (ct == cs[:, i : i + 1]) & (i < len_s)[:, None]
        found = hit.any(axis=1)
        where = hit.argmax(axis=1)
        taken_s[:, i] = found
        taken_t[rows[found], where[found]] = True
        free[rows[found], where[found]] = False
    matches = taken_s.sum(axis=1)
    depth = int(matches.max(initial=0))
    order_s = np.argsort(~taken_s, axis=1, kind="stable")[:, :depth]
    order_t = np.argsort(~taken_t, axis=1, kind="stable")[:, :depth]
    moved = np.take_along_axis(cs, order_s, 1) != np.take_along_axis(ct, order_t, 1)
    moved &= np.arange(depth) < matches[:, None]
    transposed = moved.sum(axis=1) // 2

    m = np.where(matches == 0, 1, matches).astype(float)
    jaro = (m / np.maximum(len_s, 1) + m / np.maximum(len_t, 1) + (m - transposed) / m) / 3.0
    shown = min(cs.shape[1], ct.shape[1], 4)
    same = (cs[:, :shown] == ct[:, :shown]) & (
        np.arange(shown) < np.minimum(len_s, len_t)[:, None]
    )
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    result = jaro + prefix * 0.1 * (1 - jaro)
    result[matches == 0] = 0.0
    result[s == t] = 1.0
    return result


def _jaro_winkler_batch(a: pd.Series, b: pd.Series, chunk_cells: int = 1 << 22) -> pd.Series:
    present = (a.notna() & b.notna()).to_numpy()
    s = a.to_numpy(dtype=object)[present]
    t = b.to_numpy(dtype=object)[present]
    out = np.full(len(a), np.nan)
    if len(s):
        # Rows of like length share a chunk, so a few long texts do not widen all rows.
        longest = np.fromiter((max(len(x), len(y), 1) for x, y in zip(s, t)), np.int64, len(s))
        order = np.argsort(longest, kind="stable")
        scores = np.empty(len(s))
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and (stop - start) * longest[order[stop]] < chunk_cells:
                stop = min(len(order), stop + 256)
            part = order[start:stop]
            scores[part] = _jaro_winkler_rows(s[part], t[part])
            start = stop
        out[present] = scores
    return pd.Series(out).astype("Float64").where(present)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity (1 = equal), prefix bonus always applied; NULL in, NULL out."""
    return _jaro_winkler_batch(a, b)
