"""Phrases whose words occur together more often than apart, by relational mining.

The relation of occurrences (piece, position, phrase) is kept sorted, in blocks of text that
end where a piece ends. Each round joins the occurrences of frequent phrases with those at
the next position of the same piece (a merge of sorted columns inside a block), counts the
longer phrases of all blocks by a shuffle, and keeps the occurrences whose phrase is frequent.
Only distinct phrases of a block travel; occurrences stay in their block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .words import LOWER, U64, hash_words, mix

#: Words of a phrase at most, and occurrences of one at least.
LONGEST, LEAST = 5, 100
#: Phrases reported for a language.
TOP = 2000
#: Bytes of text in a block, if a piece ends there.
BLOCK = 1 << 22
#: Distinct phrases of blocks that are counted in one place.
BUCKET = 1 << 19
#: Parts in which the first phrases of a language are looked for.
SALT = 64
UNKNOWN = "und"

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True

OCCURRENCES = "block long, n_words long, steps binary, codes binary, n_keys long"
WORDS = f"{OCCURRENCES}, lang string, words array<binary>, counts binary"
PHRASES = f"{OCCURRENCES}, lefts binary, rights binary, counts binary"
FOUND = "block long, locals binary, ids binary, id long, f long"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes; runs and small numbers take little room."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, dtype: str) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).reshape(-1)


def _unpacked(column: pa.ChunkedArray, dtype: str) -> list[np.ndarray]:
    return [unpack(x, dtype) for x in column.to_pylist()]


def slices(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Parts of about ``limit`` bytes that end at the end of a piece."""
    breaks = np.flatnonzero(BREAK[data]) + 1
    at = 0
    while at < len(data):
        k = int(np.searchsorted(breaks, at + limit, "right"))
        if k and breaks[k - 1] > at:
            to = int(breaks[k - 1])
        else:  # a piece of more than ``limit`` bytes
            to = int(breaks[k]) if k < len(breaks) else len(data)
        if at + limit >= len(data):
            to = len(data)
        yield data[at:to]
        at = to


def words_of(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-cased bytes, and the step from each to the next position.

    The step is 1 inside a piece and 2 where another piece begins.
    """
    inside = ~GAP[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(ends - begins)))
    body = np.ascontiguousarray(data[inside])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(body)]
    )
    pieces = np.searchsorted(np.flatnonzero(BREAK[data]), begins)
    return words, 1 + (np.diff(pieces, prepend=-1) > 0).astype(np.int32)


def _row(values: list, schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    arrays = [pa.array([v], t) for v, (_, t) in zip(values, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in schema])


_BASE = [
    ("block", pa.int64()),
    ("n_words", pa.int64()),
    ("steps", pa.binary()),
    ("codes", pa.binary()),
    ("n_keys", pa.int64()),
]
_WORDS = [*_BASE, ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("counts", pa.binary())]
_PHRASES = [*_BASE, ("lefts", pa.binary()), ("rights", pa.binary()), ("counts", pa.binary())]


def word_occurrences(df: DataFrame, text_column: str, lang_column: str, block: int) -> DataFrame:
    """Blocks of one language: step and code of each word, and the distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(1).filter(pc.equal(langs.indices, code))
                joined = b"\n".join(texts.cast(pa.large_binary()).to_pylist())
                for part in slices(LOWER[np.frombuffer(joined, np.uint8)], block):
                    words, steps = words_of(part)
                    if not len(words):
                        continue
                    coded = words.dictionary_encode()
                    codes = coded.indices.to_numpy(zero_copy_only=False).astype("<i4")
                    distinct = coded.dictionary.to_pylist()
                    counts = np.bincount(codes, minlength=len(distinct)).astype("<i4")
                    yield _row(
                        [
                            number,
                            len(words),
                            pack(steps),
                            pack(codes),
                            len(distinct),
                            lang,
                            distinct,
                            pack(counts),
                        ],
                        _WORDS,
                    )
                    number += 1

    read = df.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    return read.mapInArrow(run, WORDS)


def _buckets(blocks: DataFrame) -> int:
    return max(1, (blocks.agg(F.sum("n_keys")).first()[0] or 0) // BUCKET)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    found, cuts = np.unique(bucket[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, cuts[1:]), strict=True)


def _frequent(
    codes: np.ndarray, counts: np.ndarray, blocks: list, gaps: list, bucket: int, least: int
):
    """Sums by code, the codes that are frequent, and for each block its frequent entries.

    ``gaps`` are the distances between the places of a block's entries.
    """
    sums = np.zeros(int(codes.max()) + 1, np.int64)
    np.add.at(sums, codes, counts)
    often = np.flatnonzero(sums >= least)
    ids = np.full(len(sums), -1, np.int64)
    ids[often] = (bucket << 32) + np.arange(len(often))
    of_entry = ids[codes]
    back = {"block": [], "locals": [], "ids": []}
    at = 0
    for block, gap in zip(blocks, gaps, strict=True):
        mine = of_entry[at : at + len(gap)]
        at += len(gap)
        own = np.cumsum(gap, dtype="<i4")
        hit = mine >= 0
        if hit.any():
            back["block"].append(block)
            back["locals"].append(pack(own[hit]))
            back["ids"].append(pack(mine[hit]))
    return sums[often], often, ids[often], back


def _answer(back: dict, rows: dict, types: dict[str, pa.DataType]) -> pa.Table:
    """Rows for blocks (``block``, ``locals``, ``ids``), then one row for each frequent phrase."""
    n, m = len(back["block"]), len(rows["id"])
    columns = {}
    for name, kind in types.items():
        parts = [
            pa.array(back[name], kind) if name in back else pa.nulls(n, kind),
            pa.array(rows[name], kind) if name in rows else pa.nulls(m, kind),
        ]
        columns[name] = pa.chunked_array(parts, kind)
    return pa.table(columns)


_TYPES = {
    "block": pa.int64(),
    "locals": pa.binary(),
    "ids": pa.binary(),
    "id": pa.int64(),
    "f": pa.int64(),
}


def frequent_words(blocks: DataFrame, least: int) -> DataFrame:
    """Words of at least ``least`` occurrences in their language, and where blocks have them."""
    buckets = _buckets(blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = batch.column("words").slice(row, 1).flatten().cast(pa.large_binary())
                counts = unpack(batch.column("counts")[row].as_py(), "<i4")
                offsets = np.frombuffer(words.buffers()[1], np.int64)[
                    words.offset : words.offset + len(words) + 1
                ]
                data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                hashes = hash_words(data, offsets - offsets[0], np.ones(256, bool)).hashes
                out = {n: [] for n in ("bucket", "words", "counts", "locals")}
                for bucket, places in _parts((hashes % U64(buckets)).astype(np.int64)):
                    out["bucket"].append(bucket)
                    out["words"].append(words.take(pa.array(places)).cast(pa.binary()))
                    out["counts"].append(pack(counts[places]))
                    out["locals"].append(pack(np.diff(places, prepend=0).astype("<i4")))
                ends = np.concatenate(([0], np.cumsum([len(w) for w in out["words"]])))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["bucket"], pa.int64()),
                        pa.repeat(batch.column("block")[row], len(out["bucket"])),
                        pa.repeat(batch.column("lang")[row], len(out["bucket"])),
                        pa.ListArray.from_arrays(
                            pa.array(ends, pa.int32()), pa.concat_arrays(out["words"])
                        ),
                        pa.array(out["counts"], pa.binary()),
                        pa.array(out["locals"], pa.binary()),
                    ],
                    ["bucket", "block", "lang", "words", "counts", "locals"],
                )

    def count(table: pa.Table) -> pa.Table:
        lists = table.column("words").combine_chunks()
        sizes = pc.list_value_length(lists).to_pylist()
        flat = lists.flatten().cast(pa.large_binary())
        lang = table.column("lang").combine_chunks().cast(pa.binary()).cast(pa.large_binary())
        owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        # a word has no space in it, so the first space ends it
        keys = pc.binary_join_element_wise(flat, lang.take(owner), pa.scalar(b" ", pa.large_binary()))
        coded = keys.dictionary_encode()
        sums, often, ids, back = _frequent(
            coded.indices.to_numpy(zero_copy_only=False),
            np.concatenate(_unpacked(table.column("counts"), "<i4")),
            table.column("block").to_pylist(),
            _unpacked(table.column("locals"), "<i4"),
            table.column("bucket")[0].as_py(),
            least,
        )
        named = [k.split(b" ", 1) for k in coded.dictionary.take(pa.array(often)).to_pylist()]
        rows = {
            "id": ids,
            "f": sums,
            "word": [w for w, _ in named],
            "lang": [x.decode() for _, x in named],
        }
        return _answer(back, rows, {**_TYPES, "lang": pa.string(), "word": pa.binary()})

    dealt = blocks.select("block", "lang", "words", "counts").mapInArrow(
        deal, "bucket long, block long, lang string, words array<binary>, counts binary, locals binary"
    )
    return dealt.groupBy("bucket").applyInArrow(count, f"{FOUND}, lang string, word binary")


def frequent_phrases(blocks: DataFrame, least: int) -> DataFrame:
    """As ``frequent_words``, for phrases given by their first and last words but one."""
    buckets = _buckets(blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lefts, rights, counts = (
                    unpack(batch.column(c)[row].as_py(), t)
                    for c, t in (("lefts", "<i8"), ("rights", "<i8"), ("counts", "<i4"))
                )
                hashes = mix(mix(lefts.astype(U64)) + rights.astype(U64))
                out = {n: [] for n in ("bucket", "lefts", "rights", "counts", "locals")}
                for bucket, places in _parts((hashes % U64(buckets)).astype(np.int64)):
                    out["bucket"].append(bucket)
                    for name, values in (("lefts", lefts), ("rights", rights), ("counts", counts)):
                        out[name].append(pack(values[places]))
                    out["locals"].append(pack(np.diff(places, prepend=0).astype("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["bucket"], pa.int64()),
                        pa.repeat(batch.column("block")[row], len(out["bucket"])),
                        *(
                            pa.array(out[n], pa.binary())
                            for n in ("lefts", "rights", "counts", "locals")
                        ),
                    ],
                    ["bucket", "block", "lefts", "rights", "counts", "locals"],
                )

    def count(table: pa.Table) -> pa.Table:
        lefts, rights, counts = (
            np.concatenate(_unpacked(table.column(c), t))
            for c, t in (("lefts", "<i8"), ("rights", "<i8"), ("counts", "<i4"))
        )
        order = np.lexsort((rights, lefts))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(lefts[order]) != 0) | (np.diff(rights[order]) != 0)
        codes = np.empty(len(order), np.int64)
        codes[order] = np.cumsum(new) - 1
        first = order[new]
        sums, often, ids, back = _frequent(
            codes,
            counts,
            table.column("block").to_pylist(),
            _unpacked(table.column("locals"), "<i4"),
            table.column("bucket")[0].as_py(),
            least,
        )
        rows = {"id": ids, "f": sums, "left": lefts[first[often]], "right": rights[first[often]]}
        return _answer(back, rows, {**_TYPES, "left": pa.int64(), "right": pa.int64()})

    dealt = blocks.select("block", "lefts", "rights", "counts").mapInArrow(
        deal, "bucket long, block long, lefts binary, rights binary, counts binary, locals binary"
    )
    return dealt.groupBy("bucket").applyInArrow(count, f"{FOUND}, left long, right long")


def extended(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Occurrences of phrases one word longer: two frequent ones at adjacent positions."""

    def join(block: pa.Table, often: pa.Table) -> pa.Table:
        if not block.num_rows or not often.num_rows:
            return pa.schema(_PHRASES).empty_table()
        row = block.to_pylist()[0]
        codes = unpack(row["codes"], "<i4")
        ids = np.full(row["n_keys"], -1, np.int64)
        mine = np.concatenate(_unpacked(often.column("locals"), "<i4"))
        ids[mine] = np.concatenate(_unpacked(often.column("ids"), "<i8"))
        kept = np.flatnonzero(ids[codes] >= 0)
        places = np.cumsum(unpack(row["steps"], "<i4"), dtype=np.int64)[kept]
        met = np.flatnonzero(np.diff(places) == 1)
        if not len(met):
            return pa.schema(_PHRASES).empty_table()
        codes = codes[kept].astype(np.int64)
        keys, inverse, counts = np.unique(
            codes[met] * row["n_keys"] + codes[met + 1], return_inverse=True, return_counts=True
        )
        values = [
            row["block"],
            len(met),
            pack(np.diff(places[met], prepend=0).astype("<i4")),
            pack(inverse.astype("<i4")),
            len(keys),
            pack(ids[keys // row["n_keys"]]),
            pack(ids[keys % row["n_keys"]]),
            pack(counts.astype("<i4")),
        ]
        return pa.Table.from_batches([_row(values, _PHRASES)])

    sorted_ = blocks.select("block", "steps", "codes", "n_keys").groupBy("block")
    frequent = found.where("block IS NOT NULL").select("block", "locals", "ids").groupBy("block")
    return sorted_.cogroup(frequent).applyInArrow(join, PHRASES)


def phrases(
    df: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of up to ``longest`` words, and the number of words of each language.

    Phrases: id, k, lang, words, f (occurrences), heads and tails (occurrences of the first
    and of the last j words, by j), left and right (ids of all words but the last, and but
    the first; NULL for single words).
    """
    blocks = stored(word_occurrences(df, text_column, lang_column, block))
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    found = stored(frequent_words(blocks, least))
    level = found.where("id IS NOT NULL").select(
        "id",
        F.lit(1).alias("k"),
        "lang",
        F.array(F.col("word").cast("string")).alias("words"),
        "f",
        F.array("f").alias("heads"),
        F.array("f").alias("tails"),
        F.lit(None).cast("long").alias("left"),
        F.lit(None).cast("long").alias("right"),
    )
    levels = [level]
    for k in range(2, longest + 1):
        blocks = stored(extended(blocks, found))
        found = stored(frequent_phrases(blocks, least))
        head = level.select(F.col("id").alias("left"), "lang", F.col("words").alias("w"), "heads")
        tail = level.select(
            F.col("id").alias("right"), F.element_at("words", -1).alias("last"), "tails"
        )
        level = stored(
            found.where("id IS NOT NULL")
            .select("id", "left", "right", "f")
            .join(head, "left")
            .join(tail, "right")
            .select(
                "id",
                F.lit(k).alias("k"),
                "lang",
                F.array_append("w", F.col("last")).alias("words"),
                "f",
                F.array_append("heads", F.col("f")).alias("heads"),
                F.array_append("tails", F.col("f")).alias("tails"),
                "left",
                "right",
            )
        )
        levels.append(level)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every, totals


def _lowest_cut(longest: int):
    """(score, k, l, r) of the cut with the lowest score.

    Products are decimals of 38 digits: enough while a corpus has fewer than 10^17 words.
    """
    cuts = []
    for k in range(1, longest):
        both = f"CAST(heads[{k - 1}] AS DECIMAL(19)) * CAST(tails[k - {k + 1}] AS DECIMAL(19))"
        score = f"(CAST(1000 AS DECIMAL(4)) * CAST(f AS DECIMAL(19)) * CAST(n AS DECIMAL(19))) DIV ({both})"
        cuts.append(
            f"IF(k > {k}, STRUCT({score} AS score, {k} AS k, heads[{k - 1}] AS l,"
            f" tails[k - {k + 1}] AS r), NULL)"
        )
    return F.array_min(F.expr(f"ARRAY({', '.join(cuts)})"))


def collocations(
    df: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
    block: int = BLOCK,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into
    words at spaces and tabs. A phrase of 2 to ``longest`` words with a >= ``least``
    occurrences scores floor(1000 * a * n / (l * r)) at the cut where that is lowest (then the
    earliest), with n words in the language and l and r occurrences of the two parts. A phrase
    is left out if one that holds it occurs as often. Order: score, a (both falling), phrase.

    A NULL text counts as empty, a NULL language as ``und``; texts and languages without
    frequent phrases give no rows, and so does an empty table. Repeated rows count each time.
    A text of any length is cut into blocks where its pieces end. Other columns are not read.
    """
    every, totals = phrases(df, text_column, lang_column, longest, least, block)
    every = stored(every.where("k > 1"))
    # whatever holds a phrase and occurs as often holds one that is a word longer and does so
    held = every.where("f >= heads[k - 2]").select("k", F.col("left").alias("id")).union(
        every.where("f >= tails[k - 2]").select("k", F.col("right").alias("id"))
    )
    held = held.select((F.col("k") - 1).alias("k"), "id").distinct()
    scored = (
        every.join(held, ["k", "id"], "left_anti")
        .join(totals, "lang")
        .withColumn("cut", _lowest_cut(longest))
        .select(
            "lang",
            F.array_join("words", " ").alias("phrase"),
            F.col("f").alias("a"),
            "cut.l",
            "cut.r",
            "n",
            "cut.score",
        )
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each part of a language, then the first of those
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALT))
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    first = scored.withColumn("salt", salt).withColumn("place", F.row_number().over(part))
    whole = Window.partitionBy("lang").orderBy(*order)
    return (
        first.where(F.col("place") <= top)
        .withColumn("rank", F.row_number().over(whole).cast("long"))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


def oracle(longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> str:
    return f"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS ws
    FROM (
        SELECT coalesce(lang, '{UNKNOWN}') AS lang,
            unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)
), totals AS (
    SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang
), starts AS (
    SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces
), runs AS (
    SELECT lang, ws, i, unnest(range(1, least({longest}, len(ws) - i + 1) + 1)) AS k FROM starts
), often AS (
    SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase, count(*) AS f
    FROM runs GROUP BY ALL HAVING count(*) >= {least}
), cuts AS (
    SELECT lang, phrase, k, f, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut
    FROM often WHERE k > 1
), scored AS (
    SELECT c.lang, c.phrase, c.k, c.f AS a, l.f AS l, r.f AS r, t.n, c.cut,
        ((1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM cuts c
    JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.ws, 1, c.cut), ' ')
    JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.ws, c.cut + 1, c.k), ' ')
    JOIN totals t ON t.lang = c.lang
), lowest AS (
    SELECT * FROM scored
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), free AS (
    SELECT * FROM lowest s WHERE NOT EXISTS (
        SELECT 1 FROM often o WHERE o.lang = s.lang AND o.k > s.k AND o.f >= s.a
            AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
    phrase, a, l, r, n, score
FROM free
QUALIFY rank <= {top}
"""
