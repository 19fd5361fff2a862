"""BPE ids of texts, and back: long texts are encoded in parts that are joined in a tree."""

from __future__ import annotations

import heapq
import json
import os
import pickle
import re
import sys
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import free_names

#: Texts of more characters are cut into parts of this size, each a row of its own.
PART = 1 << 15
#: Symbols of a word that are merged at once; longer words are halved.
LEAF = 128
#: Distinct pieces of text whose ids a Python worker remembers.
CACHE = 500_000
#: Texts whose ids are held and passed on together, and parts of a text that are.
ROWS, CUTS = 512, 64
#: Bytes of a run without white space that are encoded when it is complete.
SHORT = 1024
#: Neighbouring parts that are joined in one place in the first round.
FAN = 64


class Merges:
    """The merge rules of one BPE vocabulary, for words given as symbols."""

    def __init__(self, pairs: Sequence):
        split = (p.split(" ") if isinstance(p, str) else p for p in pairs)
        self.ranks = {(a, b): i for i, (a, b) in enumerate(split)}

    def merge(self, symbols: list[str]) -> list[str]:
        """Join neighbours, the earliest rule first and from the left, until none applies."""
        n = len(symbols)
        out: list[str | None] = list(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [
            (rank, i)
            for i in range(n - 1)
            if (rank := self.ranks.get((symbols[i], symbols[i + 1]))) is not None
        ]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if out[i] is None or j >= n or self.ranks.get((out[i], out[j])) != rank:
                continue
            out[i], out[j] = out[i] + out[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    new = self.ranks.get((out[a], out[b]))
                    if new is not None:
                        heapq.heappush(heap, (new, a))
        return [s for s in out if s is not None]

    def settled(self, left: str, right: str, symbols) -> bool:
        """Whether two neighbouring tokens stay apart when they are encoded together."""
        return self.merge([*symbols(left), *symbols(right)]) == [left, right]

    def join(self, left: list[str], right: list[str], symbols) -> list[str]:
        """Tokens of two encoded halves put together.

        A window around the join is encoded again and grows until its first token and the one
        before it, and its last token and the one after it, stay apart: then both sides agree
        with the window, and the whole is what encoding it at once gives.
        """
        size = 1
        while True:
            a, b = left[-size:], right[:size]
            window = self.merge([s for t in (*a, *b) for s in symbols(t)])
            rest_a, rest_b = left[: len(left) - len(a)], right[len(b) :]
            if (not rest_a or self.settled(rest_a[-1], window[0], symbols)) and (
                not rest_b or self.settled(window[-1], rest_b[0], symbols)
            ):
                return [*rest_a, *window, *rest_b]
            size *= 2

    def encode(self, word: list[str], symbols, leaf: int = LEAF) -> list[str]:
        """Tokens of a word: halves are encoded alone and joined."""
        if len(word) <= leaf:
            return self.merge(word)
        half = len(word) // 2
        return self.join(
            self.encode(word[:half], symbols, leaf), self.encode(word[half:], symbols, leaf), symbols
        )


MARK = re.compile(rb"(?<=[a-z])([.,])(?=[\x20\x09-\x0D])")


def pieces_of(text: bytes) -> list[bytes]:
    """The text between white space. ASCII letters are lower-cased, as the tokenizer does
    later, and a full stop or comma after a letter is a piece of its own, as it is a word of
    its own: both make pieces repeat more often. Texts that may spell an added token, which
    is looked for before, are left alone."""
    if b"<|" in text:
        return text.split()
    return MARK.sub(rb" \1", text.lower()).split()


def added_tokens(definition: str) -> list[str]:
    return [t["content"] for t in json.loads(definition).get("added_tokens", ())]


@dataclass
class Word:
    """A word as the tokenizer cuts it, its text up to the next word, and its tokens if known."""

    text: str
    word: str
    tokens: list[str] | None

    def same(self, other: Word) -> bool:
        return (self.text, self.word) == (other.text, other.word)


@dataclass
class Run:
    """Text without white space, and its words, if it is long."""

    raw: bytes
    words: list[Word] | None


@dataclass
class Part:
    """A part of a text: its beginning up to white space, ids and decoded text of the middle,
    its end after white space. A bare part has no white space and is all beginning."""

    head: Run
    ids: bytes
    decoded: bytes
    tail: Run
    bare: bool


def packed_run(run: Run) -> bytes:
    words = run.words and [(w.text, w.word, w.tokens) for w in run.words]
    return pickle.dumps((run.raw, words))


def unpacked_run(data: bytes) -> Run:
    raw, words = pickle.loads(data)
    return Run(raw, words and [Word(*w) for w in words])


class Codec:
    """Encodes and decodes as the tokenizer does, without its added special tokens."""

    def __init__(self, definition: str, leaf: int = LEAF, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        model = json.loads(definition)["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.merges = Merges(model["merges"])
        self.leaf, self.limit = leaf, cache
        self.ids: dict[bytes, bytes] = {}
        if '"Lowercase"' not in definition or any("<|" not in t for t in added_tokens(definition)):
            raise ValueError("the tokenizer has to drop white space and lower-case words")
        if json.loads(definition).get("decoder"):
            raise ValueError("the tokenizer has a decoder of its own")
        names = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        self.tokens = [t.encode() for t, _ in names]
        if [i for _, i in names] != list(range(len(names))):
            raise ValueError("ids have gaps")
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are packed as the machine has them")
        added = added_tokens(definition)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            return [*token[: -len(self.end) - 1], token[-len(self.end) - 1 :]]
        return list(token)

    def unsplit(self, text: str) -> list[int]:
        """Ids of a text without white space."""
        out, at = [], 0
        for m in self.added.finditer(text) if self.added else ():
            out += self._words(text[at : m.start()])
            out.append(self.tokenizer.token_to_id(m[0]))
            at = m.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[int]:
        if not text:
            return []
        plain = self.tokenizer.normalizer.normalize_str(text)
        out = []
        for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain):
            if len(word) <= self.leaf:
                out += [t.id for t in self.tokenizer.model.tokenize(word)]
            else:
                letters = [*word[:-1], word[-1] + self.end]
                tokens = self.merges.encode(letters, self.symbols, self.leaf)
                out += [self.tokenizer.token_to_id(t) for t in tokens]
        return out

    def learn(self, pieces: set[bytes]) -> None:
        """Remember the ids of pieces of text without white space."""
        new = pieces.difference(self.ids)
        if len(self.ids) + len(new) > self.limit:
            self.ids.clear()
            new = pieces
        short = [p for p in new if len(p) <= self.leaf]
        found = self.tokenizer.encode_batch_fast(
            list(map(bytes.decode, short)), add_special_tokens=False
        )
        self.ids.update(zip(short, [array("I", e.ids).tobytes() for e in found], strict=True))
        if len(short) < len(new):
            for piece in new:
                if len(piece) > self.leaf:
                    self.ids[piece] = array("I", self.unsplit(piece.decode())).tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The text of ids: their tokens with spaces between, as the tokenizer has no decoder."""
        return b" ".join(map(self.tokens.__getitem__, array("I", ids)))

    def encode(self, pieces: list[bytes]) -> tuple[bytes, bytes]:
        """Ids, 32 bits each, and the decoded text of learnt pieces."""
        ids = b"".join(map(self.ids.__getitem__, pieces))
        return ids, self.decode(ids)

    def encode_texts(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Whole texts. No token crosses white space, so each piece between is looked up; the
        texts of a block are learnt together."""
        at = 0
        while at < len(texts):
            block, size = [], 0
            while at < len(texts) and (not block or size + len(texts[at]) < 4 * PART * 8):
                block.append(pieces_of(texts[at]))
                size += len(texts[at])
                at += 1
            self.learn(set().union(*block))
            yield from map(self.encode, block)

    def words(self, text: str) -> list[Word]:
        """The words of a text, each with the text up to the next one. A text of characters
        that the tokenizer drops has one empty word."""
        plain = self.tokenizer.normalizer.normalize_str(text)
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)
        if not found:
            return [Word(plain, "", [])]
        cuts = [0, *(start for _, (start, _) in found[1:]), len(plain)]
        return [Word(plain[i:j], w, None) for (w, _), i, j in zip(found, cuts, cuts[1:])]

    def tokens_of(self, word: Word) -> list[str]:
        if word.tokens is None:
            letters = [*word.word[:-1], word.word[-1] + self.end]
            word.tokens = self.merges.encode(letters, self.symbols, self.leaf)
        return word.tokens

    def joined_tokens(self, a: Word, b: Word) -> list[str]:
        """Tokens of the word that two make together, from the tokens of both.

        All tokens of ``a`` but the last are those of its beginning; the last is encoded again
        without the mark of a word's end, and windows grow around both joins.
        """
        *begin, last = self.tokens_of(a)
        letters = self.symbols(last.removesuffix(self.end) if self.end else last)
        whole = self.merges.join(begin, self.merges.merge(letters), self.symbols) if begin else self.merges.merge(letters)
        return self.merges.join(whole, self.tokens_of(b), self.symbols)

    def join_words(self, a: list[Word], b: list[Word]) -> list[Word]:
        """The words of two halves of a text put together.

        The window around the join is cut into words again, and grows until its first and its
        last word are those that the halves have there: from there on, both agree with it.
        """
        size = 1
        while True:
            left, right = a[-size:], b[:size]
            window = self.words("".join(w.text for w in (*left, *right)))
            first = len(left) == len(a) or window and window[0].same(left[0])
            last = len(right) == len(b) or window and window[-1].same(right[-1])
            if first and last:
                break
            size *= 2
        known = {w.word: w for w in (*left, *right)}
        for w in window:
            if w.word in known:
                w.tokens = self.tokens_of(known[w.word])
            elif left and right and w.word == left[-1].word + right[0].word:
                w.tokens = self.joined_tokens(left[-1], right[0])
        return [*a[: len(a) - len(left)], *window, *b[len(right) :]]

    def run(self, raw: bytes) -> Run:
        """A text without white space. Short ones, and those that may spell an added token, are
        encoded when they are complete."""
        if len(raw) <= SHORT or b"<|" in raw:
            return Run(raw, None)
        words = self.words(raw.decode())
        for w in words:
            self.tokens_of(w)
        return Run(raw, words)

    def join_runs(self, a: Run, b: Run) -> Run:
        if not a.raw or not b.raw:
            return a if a.raw else b
        raw = a.raw + b.raw
        if len(raw) <= SHORT or b"<|" in raw:
            return Run(raw, None)
        sides = [r.words if r.words is not None else self.words(r.raw.decode()) for r in (a, b)]
        return Run(raw, self.join_words(*sides))

    def close(self, run: Run) -> tuple[bytes, bytes]:
        """Ids and decoded text of a complete run."""
        if not run.raw:
            return b"", b""
        if run.words is None:
            self.learn({run.raw})
            return self.encode([run.raw])
        ids = array("I", [self.tokenizer.token_to_id(t) for w in run.words for t in self.tokens_of(w)])
        return ids.tobytes(), self.decode(ids.tobytes())

    def encode_part(self, part: bytes) -> Part:
        """One part of a text."""
        if not part or not re.search(rb"[\x20\x09-\x0D]", part):
            return Part(self.run(part), b"", b"", Run(b"", None), True)
        head = part.split(None, 1)[0] if part[:1].split() else b""
        tail = part.rsplit(None, 1)[-1] if part[-1:].split() else b""
        pieces = pieces_of(part[len(head) : len(part) - len(tail)])
        self.learn(set(pieces))
        return Part(self.run(head), *self.encode(pieces), self.run(tail), False)

    def join_parts(self, a: Part, b: Part) -> Part:
        """Two neighbouring parts as one.

        White space is where both sides agree at once. The runs that meet at the join are
        joined word by word; if they hold no white space on a side, they stay open.
        """
        if a.bare:
            return Part(self.join_runs(a.head, b.head), b.ids, b.decoded, b.tail, b.bare)
        if b.bare:
            return Part(a.head, a.ids, a.decoded, self.join_runs(a.tail, b.head), False)
        ids, decoded = self.close(self.join_runs(a.tail, b.head))
        text = b" ".join(x for x in (a.decoded, decoded, b.decoded) if x)
        return Part(a.head, a.ids + ids + b.ids, text, b.tail, False)

    def join_all(self, parts: list[Part]) -> Part:
        """Join neighbours level by level."""
        while len(parts) > 1:
            parts = [
                self.join_parts(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i]
                for i in range(0, len(parts), 2)
            ]
        return parts[0]

    def whole(self, part: Part) -> tuple[bytes, bytes]:
        """Ids and decoded text of all parts of a text joined."""
        first, last = self.close(part.head), self.close(part.tail)
        return (
            first[0] + part.ids + last[0],
            b" ".join(x for x in (first[1], part.decoded, last[1]) if x),
        )


_codecs: dict[tuple, Codec] = {}


def codec(definition: str, leaf: int = LEAF) -> Codec:
    """One codec in each Python worker, which remembers pieces from task to task."""
    key = (hash(definition), leaf)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(definition, leaf)
    return _codecs[key]


CODED = "ids binary, decoded string"
CODED_ARROW = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])


def _coded(rows: list[tuple[bytes, bytes]]) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.binary()),
            pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()),
        ],
        fields=list(CODED_ARROW),
    )


def _columns(parts: list[Part]) -> list[pa.Array]:
    return [
        pa.array([packed_run(p.head) for p in parts], pa.binary()),
        pa.array([p.ids for p in parts], pa.binary()),
        pa.array([p.decoded for p in parts], pa.binary()),
        pa.array([packed_run(p.tail) for p in parts], pa.binary()),
        pa.array([p.bare for p in parts], pa.bool_()),
    ]


def _parts(table: pa.Table) -> list[Part]:
    return [
        Part(unpacked_run(r["head"]), r["ids"], r["decoded"], unpacked_run(r["tail"]), r["bare"])
        for r in table.to_pylist()
    ]


def encoded(
    df: DataFrame,
    path: str,
    text_column: str = "text",
    part: int = PART,
    leaf: int = LEAF,
) -> DataFrame:
    """``df`` with the columns ids (32-bit little-endian numbers) and decoded.

    ``path`` is a tokenizer file that the driver reads; tasks get its content. ids are those
    of encoding the whole text without adding special tokens, decoded is the text of these
    ids. Texts of up to ``part`` characters are encoded where they are read. Each longer text
    is encoded once, however many copies it has: its parts are dealt over all tasks, then
    joined, ``FAN`` neighbours in one place and then the rest. Parts without white space are
    encoded alike, and windows of words and tokens around each join are encoded again until
    both sides agree. What one task holds is bounded by one text.

    NULL counts as empty; an empty text has no ids. Repeated rows are encoded alike, an empty
    table stays empty. Columns of ``df`` named ids or decoded are replaced.
    """
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    sent = df.sparkSession.sparkContext.broadcast(definition)
    key, number, code = free_names(df, "text_key", "part_number", "code")

    @F.arrow_udf(CODED)
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(sent.value, leaf)
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                texts = batch.slice(first, ROWS).cast(pa.binary()).to_pylist()
                yield _coded(list(own.encode_texts(texts)))

    def in_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                for first in range(0, len(text), part * CUTS):
                    cuts = range(first, min(first + part * CUTS, len(text)), part)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(batch.column(0)[row], len(cuts)),
                            pa.array([i // part for i in cuts], pa.int32()),
                            pa.array([text[i : i + part] for i in cuts], pa.string()),
                        ],
                        [key, number, "text"],
                    )

    names = (key, number, "head", "ids", "decoded", "tail", "bare")

    def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value, leaf)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            parts = [own.encode_part(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_columns(parts)], names)

    def neighbours(table: pa.Table) -> pa.Table:
        own = codec(sent.value, leaf)
        table = table.sort_by(number)
        first = [table.column(key)[:1], pa.array([table.column(number)[0].as_py() // FAN], pa.int32())]
        return pa.table([*first, *_columns([own.join_all(_parts(table))])], names)

    def together(table: pa.Table) -> pa.Table:
        own = codec(sent.value, leaf)
        joined = own.join_all(_parts(table.sort_by(number)))
        return pa.table({key: table.column(key)[:1], code: _coded([own.whole(joined)])})

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    long = F.length(text) > part
    rest = [F.col(c) for c in df.columns if c not in ("ids", "decoded")]
    short = df.where(~long).select(*rest, whole(text).alias(code))
    marked = df.where(long).withColumn(key, F.sha2(F.encode(text, "utf-8"), 256))
    distinct = marked.select(key, text.alias("text")).dropDuplicates([key])
    cut = distinct.mapInArrow(in_cuts, f"{key} string, {number} int, text string")
    part_rows = f"{key} string, {number} int, head binary, ids binary, decoded binary, tail binary, bare boolean"
    parts = cut.repartition(key, number).mapInArrow(in_parts, part_rows)
    some = F.floor(F.col(number) / FAN)
    parts = parts.groupBy(key, some).applyInArrow(neighbours, part_rows)
    joined = parts.groupBy(key).applyInArrow(together, f"{key} string, {code} struct<{CODED}>")
    names = [c for c in df.columns if c not in ("ids", "decoded")]
    both = short.unionByName(marked.join(joined, key).select(*names, code))
    return both.select(*names, F.col(f"{code}.ids"), F.col(f"{code}.decoded"))


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
