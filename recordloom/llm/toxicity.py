"""Toxicity of texts by a small convolutional network over hashed word embeddings."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import free_names
from .shipping import received, sent
from .words import ALNUM, U64, blocks, hash_words, text_bytes

#: Rows of the embedding table, and numbers in a row.
ROWS, SIZE = 1 << 16, 16
#: Words a filter looks at, and filters of each width.
WIDTHS, FILTERS = (1, 2, 3), 8
#: Bytes of a word's beginnings that have an embedding besides the word itself.
PREFIXES = (4, 6)
#: Labelled texts of each class that are learnt from, at most. Texts are taken whole.
MAX_TEXTS = 3000
EPOCHS, BATCH, RATE = 10, 32, 0.01
#: False alarms that are as bad as a missed text.
MISSED = 2.0
#: Texts that a word is learnt from, at least.
LEAST_TEXTS = 4
#: Part of the learnt texts that only sets the thresholds.
CALIBRATION = 5
FOLDS = 5

#: Frequent words by which the language of a text is told (fixed values).
LANGUAGES = {
    "en": "the of and to in is that for it with as was on be by this are or an at from",
    "de": "der die das und ist nicht ein eine zu den mit von auf für im dem des sich als auch",
    "fr": "le la les de des et un une que qui dans pour est sur pas avec au du ce il",
    "es": "el la los las de que y en un una por con para es se lo del al como su",
}


def fold_of(key: Column) -> Column:
    """crc32 of the key as text, modulo ``FOLDS``; NULL counts as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS


@dataclass
class Texts:
    """Embedding rows of the words of several texts."""

    rows: np.ndarray  # one column for the word, one for each prefix
    starts: np.ndarray


def read_texts(data: np.ndarray, offsets: np.ndarray) -> Texts:
    """Words are lower-cased runs of letters and digits."""
    words = hash_words(data, offsets, ALNUM, lower_latin=True, prefixes=PREFIXES)
    columns = [words.hashes, *words.prefixes]
    rows = np.stack([(c >> U64(40)).astype(np.int64) % ROWS for c in columns], axis=1)
    return Texts(rows, words.starts)


def language_table() -> np.ndarray:
    """For each embedding row, the languages whose frequent words fall on it."""
    table = np.zeros((ROWS, len(LANGUAGES)), np.float32)
    for k, words in enumerate(LANGUAGES.values()):
        texts = read_texts(*text_bytes(pa.array(words.split())))
        table[texts.rows[:, 0], k] = 1
    return table


@dataclass
class Model:
    """The network, and a threshold on its output for each language."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1))

    def pooled(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest response of each filter in each text, where it is, and the embeddings.

        Words beyond the end of a text count as zeros, so short texts have responses too;
        a text without words has none.
        """
        starts, counts = texts.starts[:-1], np.diff(texts.starts)
        embedded = self.table[texts.rows].sum(axis=1)
        padded = np.concatenate((embedded, np.zeros((max(WIDTHS), SIZE), np.float32)))
        n, full = len(embedded), np.flatnonzero(counts)
        values = np.zeros((len(counts), len(WIDTHS) * FILTERS), np.float32)
        where = np.zeros(values.shape, np.int64)
        text = np.repeat(np.arange(len(counts)), counts)
        rest = texts.starts[text + 1] - np.arange(n) if n else np.zeros(0, np.int64)
        for k, width in enumerate(WIDTHS):
            response = np.zeros((n, FILTERS), np.float32)
            for j in range(width):
                piece = padded[j : j + n] @ self.filters[k][j]
                if j:
                    piece[rest <= j] = 0
                response += piece
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            if len(full):
                values[full, own] = np.maximum.reduceat(response, starts[full], axis=0)
                if self.training:
                    for i in full:
                        part = response[starts[i] : starts[i] + counts[i]]
                        where[i, own] = part.argmax(axis=0) + starts[i]
        return values + self.bias * (counts > 0)[:, None], where, padded

    training = False

    def logits(self, texts: Texts) -> np.ndarray:
        values, _, _ = self.pooled(texts)
        return np.maximum(values, 0) @ self.out + self.out_bias

    def languages(self, texts: Texts, table: np.ndarray) -> np.ndarray:
        """The language with most frequent words in each text; the last number if none has."""
        full = np.flatnonzero(np.diff(texts.starts))
        out = np.full(len(texts.starts) - 1, len(LANGUAGES))
        if len(full):
            hits = np.add.reduceat(table[texts.rows[:, 0]], texts.starts[:-1][full], axis=0)
            out[full] = np.where(hits.max(axis=1) > 0, hits.argmax(axis=1), len(LANGUAGES))
        return out

    def score(self, texts: Texts, table: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 is the threshold of the text's language."""
        shifted = self.logits(texts) - self.thresholds[self.languages(texts, table)]
        return 1 / (1 + np.exp(-np.clip(shifted.astype(np.float64), -30, 30)))


PARTS = ("table", "bias", "out", "out_bias", "thresholds")


def new_model(seed: int = 3) -> Model:
    r = np.random.default_rng(seed)
    normal = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
    return Model(
        normal(ROWS, SIZE, by=0.1),
        [normal(w, SIZE, FILTERS, by=1 / np.sqrt(w * SIZE)) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        normal(len(WIDTHS) * FILTERS, by=0.3),
        0.0,
    )


class Adam:
    """Steps for some arrays; of the embedding table only the rows in use are moved."""

    def __init__(self, rate: float):
        self.rate, self.first, self.second, self.time = rate, {}, {}, 0

    def step(self, name: str, value: np.ndarray, slope: np.ndarray, rows=slice(None)) -> None:
        if name not in self.first:
            self.first[name], self.second[name] = np.zeros_like(value), np.zeros_like(value)
        a, b = self.first[name], self.second[name]
        a[rows] = 0.9 * a[rows] + 0.1 * slope
        b[rows] = 0.999 * b[rows] + 0.001 * slope * slope
        t = max(1, self.time)
        size = a[rows] / (1 - 0.9**t) / (np.sqrt(b[rows] / (1 - 0.999**t)) + 1e-8)
        value[rows] -= self.rate * size


def class_weights(truth: np.ndarray, share: float) -> np.ndarray:
    """What each text counts, so that both classes count alike."""
    return np.where(truth == 1, 0.5 / share, 0.5 / (1 - share))


def log_loss(model: Model, texts: Texts, truth: np.ndarray, share: float) -> float:
    z = model.logits(texts).astype(np.float64)
    loss = np.logaddexp(0, z) - truth * z
    return float((loss * class_weights(truth, share)).mean())


def slopes(model: Model, texts: Texts, truth: np.ndarray, share: float) -> dict:
    """The slopes of ``log_loss`` in every array of the model. Those of the table come with the
    rows they belong to: only words where a filter responds most have one, by max pooling."""
    values, where, padded = model.pooled(texts)
    active = np.maximum(values, 0)
    probability = 1 / (1 + np.exp(-np.clip(active @ model.out + model.out_bias, -30, 30)))
    weight = class_weights(truth, share)
    slope = ((probability - truth) * weight / len(truth)).astype(np.float32)
    back = slope[:, None] * model.out * (values > 0)
    found = {"out": active.T @ slope, "out_bias": float(slope.sum()), "bias": back.sum(axis=0)}
    counts = np.diff(texts.starts)
    moved_rows, moved = [], []
    for k, width in enumerate(WIDTHS):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        at, g = where[:, own], back[:, own]
        for j in range(width):
            inside = (at + j < texts.starts[1:, None]) & (counts[:, None] > 0) & (g != 0)
            i, f = np.nonzero(inside)
            place = at[i, f] + j
            own_slopes = np.zeros_like(model.filters[k][j])
            np.add.at(own_slopes.T, f, padded[place] * g[i, f][:, None])
            moved_rows.append(texts.rows[place])
            moved.append(g[i, f][:, None] * model.filters[k][j].T[f])
            found[k, j] = own_slopes
    rows = np.concatenate(moved_rows)
    used, inverse = np.unique(rows, return_inverse=True)
    of_table = np.zeros((len(used), SIZE), np.float32)
    if len(rows):
        each = np.repeat(np.concatenate(moved), rows.shape[1], axis=0)
        np.add.at(of_table, inverse.reshape(-1), each)
    found["table"] = used, of_table
    return found


def known_rows(parts: list[Texts], least: int) -> np.ndarray:
    """Whether each row of the table belongs to words of at least ``least`` texts."""
    seen = np.zeros(ROWS, np.int64)
    for texts in parts:
        for a, b in zip(texts.starts[:-1], texts.starts[1:], strict=True):
            seen[np.unique(texts.rows[a:b])] += 1
    return seen >= least


def train(parts: list[Texts], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Minimise the log loss, the rarer class weighted up, over batches of texts.

    Words of few texts have no embedding: else the network would know its examples by them,
    and words it never saw would be noise.
    """
    model, adam = new_model(seed), Adam(RATE)
    model.training = True
    known = known_rows(parts, LEAST_TEXTS if sum(map(len, labels)) >= 50 * LEAST_TEXTS else 1)
    model.table[~known] = 0
    share = np.clip(np.concatenate(labels).mean(), 0.01, 0.99)
    order = np.random.default_rng(seed)
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / epochs) + 1e-4
        for p in order.permutation(len(parts)):
            adam.time += 1
            found = slopes(model, parts[p], labels[p], share)
            adam.step("out", model.out, found["out"] + 1e-4 * model.out)
            model.out_bias -= adam.rate * found["out_bias"]
            adam.step("bias", model.bias, found["bias"])
            for k, width in enumerate(WIDTHS):
                for j in range(width):
                    adam.step(f"filter{width}.{j}", model.filters[k][j], found[k, j])
            used, of_table = found["table"]
            used, of_table = used[known[used]], of_table[known[used]]
            if len(used):
                adam.step("table", model.table, of_table, used)
    model.training = False
    return model


def even_odds(logits: np.ndarray, truth: np.ndarray, missed: float = 1.0) -> float:
    """The logit at which both classes are equally likely, by Platt's method; or, if a missed
    text of class 1 is as bad as ``missed`` false alarms, at which either answer costs the same.

    A logistic curve is fitted to smoothed labels by Newton steps, so single odd examples do
    not move it far and classes that do not overlap do no harm.
    """
    if not truth.any() or truth.all():
        return 0.0
    n1, n0 = truth.sum(), (1 - truth).sum()
    goal = np.where(truth == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([logits.astype(np.float64), np.ones(len(logits))], axis=1)
    line = np.array([0.3, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        slope = x.T @ (p - goal) + 1e-3 * line
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        line -= step * min(1.0, 1.0 / np.abs(step).max())
    if line[0] <= 0:
        return 0.0
    return float(np.clip(-(line[1] + np.log(missed)) / line[0], logits.min(), logits.max()))


def set_thresholds(
    model: Model, logits: np.ndarray, languages: np.ndarray, truth: np.ndarray
) -> None:
    """A threshold for each language that has examples of both classes, else the common one."""
    model.thresholds[:] = even_odds(logits, truth, MISSED)
    for k in range(len(LANGUAGES)):
        own = languages == k
        if min(truth[own].sum(), (1 - truth[own]).sum()) >= 5:
            model.thresholds[k] = even_odds(logits[own], truth[own], MISSED)


def fit(texts: list[str | None], truth: list[int]) -> Model | None:
    """A calibrated model; None without examples of both classes."""
    truth = np.asarray(truth, np.float32)
    if len(set(truth.tolist())) < 2:
        return None
    order = np.random.default_rng(11).permutation(len(truth))
    read = lambda ids: read_texts(*text_bytes(pa.array([texts[i] for i in ids], pa.string())))
    table = language_table()
    held = order[::CALIBRATION] if len(order) >= 50 else order
    learnt = np.setdiff1d(order, held, assume_unique=True) if len(order) >= 50 else order
    if not 0 < truth[learnt].sum() < len(learnt):
        learnt = order
    learnt = np.random.default_rng(12).permutation(learnt)
    groups = [learnt[i : i + BATCH] for i in range(0, len(learnt), BATCH)]
    model = train([read(g) for g in groups], [truth[g] for g in groups])
    logits = []
    languages = []
    for i in range(0, len(held), 256):
        part = read(held[i : i + 256])
        logits.append(model.logits(part))
        languages.append(model.languages(part, table))
    set_thresholds(model, np.concatenate(logits), np.concatenate(languages), truth[held])
    return model


def examples(
    docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, max_texts: int
) -> DataFrame:
    """Whole labelled texts outside the held-out fold, ``max_texts`` of each class at most,
    chosen by a hash of the id: the bound is what the task that trains holds."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(fold_of(F.col("doc_id")) != 0)
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("label_id"), "label_id")
        part = part.limit(max_texts)
        chosen = part if chosen is None else chosen.union(part)
    read = docs.select(F.col(id_column).alias("label_id"), F.col(text_column).alias("text"))
    return read.join(F.broadcast(chosen), "label_id")


def packed(model: Model) -> bytes:
    out = io.BytesIO()
    np.savez(out, *model.filters, **{n: getattr(model, n) for n in PARTS})
    return out.getvalue()


def unpacked(data: bytes) -> Model:
    with np.load(io.BytesIO(data)) as read:
        parts = {n: read[n] for n in PARTS}
        parts["out_bias"] = float(parts["out_bias"])
        return Model(filters=[read[f"arr_{k}"] for k in range(len(WIDTHS))], **parts)


def trained(chosen: DataFrame) -> Model | None:
    """The model of these examples, trained in one task; only the model reaches the driver."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: (r["label_id"], r["text"] or ""))
        model = fit([r["text"] for r in rows], [r["label"] for r in rows])
        return pa.table({"model": pa.array([model and packed(model)], pa.binary())})

    found = chosen.withColumn("part", F.lit(0)).groupBy("part")
    found = found.applyInArrow(run, "model binary").collect()
    return unpacked(found[0]["model"]) if found and found[0]["model"] else None


def scored(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    max_texts: int = MAX_TEXTS,
) -> DataFrame:
    """``docs`` with the columns held_out, score and predicted.

    The network is trained on labelled rows outside the held-out fold and sees texts alone;
    the language that chooses the threshold is told from the words. NULL and empty texts have
    the score of no words. Labels that are NULL are not used, of several labels of a document
    the highest counts. Without labels of both classes every score is 0. Columns of ``docs``
    with the names of the new ones are replaced; repeated rows are scored alike, and an empty
    table stays empty. A text of any length is scored whole, in one task.
    """
    model = trained(examples(docs, labels, id_column, text_column, max_texts))
    shipped = sent(docs.sparkSession, (model, language_table()))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, table = received(shipped)
        for batch in batches:
            out = np.zeros(len(batch))
            data, offsets = text_bytes(batch)
            for first, last in blocks(offsets) if model is not None else ():
                base = offsets[first]
                texts = read_texts(data[base : offsets[last]], offsets[first : last + 1] - base)
                out[first:last] = model.score(texts, table)
            yield pa.array(out)

    return docs.withColumns(
        {
            "held_out": fold_of(F.col(id_column)) == 0,
            "score": score(F.col(text_column).cast("string")),
        }
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns.

    Rows with NULL ids or texts are judged like others; see ``scored``.
    """
    marks = ["held_out", "score", "predicted"]
    renamed = free_names(docs, *marks)
    own = dict(zip(marks, renamed, strict=True))
    moved = docs.withColumnsRenamed({c: own[c] for c in docs.columns if c in own})
    kept = scored(moved, labels, **how).where("predicted = 0")
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))
