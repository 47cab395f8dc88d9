"""A quality classifier by co-training of two views of a document.

The text view sees what is written: hashed byte trigrams, case kept, and whether a word repeats the
one before. The metadata view sees what stands about the page: source, language, its length and
layout (lines, words to a line, shares of letters, capitals, digits, punctuation and space). Each is a
naive Bayes classifier over hashed features. In every round each view scores all unlabelled
documents, and those it is sure of become training rows of the other view with its label. In the end each
view is calibrated by logistic regression on labelled rows that it was not trained on, a second
regression on the same rows combines the two, and all documents are scored.

Naive Bayes is sums of features by label, so a round is one pass over the documents that sums them
where they are: a task sends its sums for TEXT_CELLS + META_CELLS cells, whatever it has read. The
pseudo-labelled documents of a label weigh as much as the labelled ones together at most.

Fitting takes LABELLED labelled rows at most, those with the smallest hashes of doc_id; pseudo-labels
and scores cover every other row and whole texts.

Defined cases: null and empty texts have no trigrams and are scored by metadata and length; very long
texts count like others, by shares of their trigrams; null source or language is a value of its own;
without labelled rows of both kinds, or where none of a kind falls to the training or to the
calibrating part, all scores are 0.5; labels with a null are skipped, and a document with several
labels takes the least; repeated rows score alike; an empty table gives an empty table; extra columns
are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import cut, trim

#: Labelled rows that fitting takes at most.
LABELLED = 8000
#: Passes over the unlabelled documents, and the probability from which on a label is passed on.
ROUNDS, SURE = 2, 0.9
TEXT_CELLS, META_CELLS = 1 << 16, 1 << 10
#: What one repeated word counts, in trigrams; it has the last text cell.
AGAIN = 4
THRESHOLD = 0.5
SMOOTH = 0.1
_U = np.uint64
_ALL = TEXT_CELLS + META_CELLS

_CLASS = np.zeros(256, np.int64)
for _group, _bytes in ((1, b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t\n\r\x0b\x0c")):
    _CLASS[list(_bytes)] = _group


@dataclass
class Features:
    """Of n rows: every trigram's row and cell, the repeated words and the weight of all trigrams and
    repeated words of each row, the metadata cells (n, features), and the bytes."""

    n: int
    row: np.ndarray
    cell: np.ndarray
    again: np.ndarray
    total: np.ndarray
    meta: np.ndarray
    size: np.ndarray


def _log(x: np.ndarray, base: float) -> np.ndarray:
    return (np.log1p(x) / np.log(base) + 1e-9).astype(np.int64)


def meta_cells(size: np.ndarray, n_words: np.ndarray, lines: np.ndarray, kinds: np.ndarray, sources: list, langs: list) -> np.ndarray:
    """One cell for each metadata value; kinds: bytes of each class."""
    name = lambda x: -1 if x is None else zlib.crc32(str(x).encode())
    values = [
        np.array([name(x) for x in sources], np.int64), np.array([name(x) for x in langs], np.int64), _log(size, 2), _log(n_words, 2), _log(lines, 2),
        _log(n_words / lines, 1.7), _log(size / np.maximum(1, n_words), 1.3),
        *[(20 * np.sqrt(kinds[:, k] / np.maximum(1, size)) + 1e-9).astype(np.int64) for k in range(5)],
    ]
    coded = [(v + 1).astype(_U) + (_U(i + 1) << _U(40)) for i, v in enumerate(values)]
    return (sh.mix(np.column_stack(coded)) % _U(META_CELLS)).astype(np.int64)


def features(texts: pa.Array, sources: list, langs: list) -> Iterator[tuple[int, Features]]:
    """(first row, features) of runs of rows."""
    for at, ends, data in sh.chunks(texts):
        n, size = len(ends) - 1, np.diff(ends)
        h, first = sh.words(ends, data)
        counts = np.diff(first)
        of_word = np.repeat(np.arange(n), counts)
        twice = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1]) if len(h) > 1 else np.zeros(0, bool)
        again = AGAIN * np.bincount(of_word[1:][twice], minlength=n) if len(h) > 1 else np.zeros(n, np.int64)
        of_byte = np.repeat(np.arange(n), size)
        row = cell = np.zeros(0, np.int64)
        if len(data) >= 3:
            inside = of_byte[:-2] == of_byte[2:]
            d = data.astype(_U)
            cell = (sh.mix(((d[:-2] << _U(16)) | (d[1:-1] << _U(8)) | d[2:])[inside]) % _U(TEXT_CELLS - 1)).astype(np.int64)
            row = of_byte[:-2][inside]
        kinds = np.bincount(of_byte * 5 + _CLASS[data], minlength=5 * n).reshape(n, 5)
        lines = np.bincount(of_byte[data == 10], minlength=n) + 1
        meta = meta_cells(size, counts, lines, kinds, sources[at : at + n], langs[at : at + n])
        yield at, Features(n, row, cell, again, np.bincount(row, minlength=n) + again, meta, size)


class View:
    """Log-odds of each cell, and a calibration."""

    def __init__(self, odds: np.ndarray, coef: list[float] | None = None) -> None:
        self.odds, self.coef = odds, coef or [0.0, 1.0, 0.0]

    def raw(self, f: Features) -> np.ndarray:
        """(n, 3): a constant, the evidence, the size."""
        if len(self.odds) == META_CELLS:
            x = self.odds[f.meta].sum(axis=1)
        else:
            x = 10 * (np.bincount(f.row, self.odds[f.cell], f.n) + f.again * self.odds[-1]) / np.maximum(1, f.total)
        return np.column_stack([np.ones(f.n), x, np.log1p(f.size) / 10])

    def logit(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(raw @ np.array(self.coef), -12, 12)


class Model:
    def __init__(self, text: View, meta: View, coef: list[float]) -> None:
        self.text, self.meta, self.coef = text, meta, coef

    def score(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality: text view, metadata view, both."""
        a, b = self.text.logit(self.text.raw(f)), self.meta.logit(self.meta.raw(f))
        both = self.coef[0] + self.coef[1] * a + self.coef[2] * b
        return sigmoid(a), sigmoid(b), sigmoid(np.clip(both, -30, 30))

    def to_json(self) -> str:
        return json.dumps([[[round(float(x), 5) for x in v.odds], v.coef] for v in (self.text, self.meta)] + [self.coef])


def model_from_json(text: str) -> Model:
    t, m, coef = json.loads(text)
    return Model(View(np.array(t[0]), t[1]), View(np.array(m[0]), m[1]), coef)


EVEN = Model(View(np.zeros(TEXT_CELLS), [0.0, 0.0, 0.0]), View(np.zeros(META_CELLS), [0.0, 0.0, 0.0]), [0.0, 0.0, 0.0])


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton's method; the first column is the constant."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(40):
        p = sigmoid(np.clip(x @ beta, -30, 30))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return [round(float(b), 6) for b in beta]


def _count(packed: str | None):
    """Sums of features by label: (place, mass), where place is label * (all cells) + cell, text cells
    first. Without a model rows count under their own ``quality``, with one under what the other view
    says of them, if it is sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_from_json(packed) if packed else None
        mass = np.zeros(2 * _ALL)
        for b in batches:
            for at, f in features(b.column("text"), b.column("source").to_pylist(), b.column("lang").to_pylist()):
                if model:
                    by_text, by_meta, _ = model.score(f)
                    own = [np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1)) for p in (by_meta, by_text)]
                else:
                    own = [b.column("quality").to_numpy()[at : at + f.n]] * 2
                for label in (0, 1):
                    w = (own[0] == label) / np.maximum(1, f.total)
                    base = label * _ALL
                    mass[base : base + TEXT_CELLS] += np.bincount(f.cell, w[f.row], TEXT_CELLS)
                    mass[base + TEXT_CELLS - 1] += (w * f.again).sum()
                    mass[base + TEXT_CELLS : base + _ALL] += np.bincount(f.meta[own[1] == label].ravel(), minlength=META_CELLS)
        at = np.flatnonzero(mass)
        yield from pa.Table.from_arrays([pa.array(at.astype(np.int32)), pa.array(mass[at])], names=["place", "mass"]).to_batches(max_chunksize=10_000)
        trim()

    return run


def counts(rows: DataFrame, model: Model | None = None) -> np.ndarray:
    """(label, cell) sums over all rows; 2 * (TEXT_CELLS + META_CELLS) numbers come to the driver."""
    sums = rows.mapInArrow(_count(model.to_json() if model else None), "place int, mass double").groupBy("place").agg(F.sum("mass").alias("mass")).toPandas()
    out = np.zeros(2 * _ALL)
    out[sums["place"].to_numpy(int)] = sums["mass"].to_numpy(float)
    return out.reshape(2, _ALL)


def train(labelled: np.ndarray, pseudo: np.ndarray | None = None) -> tuple[View, View]:
    """The text and the metadata view from sums of features; pseudo weighs as much as labelled at most."""
    out = []
    for part in (slice(0, TEXT_CELLS), slice(TEXT_CELLS, _ALL)):
        odds = 0.0
        for label, sign in ((1, 1.0), (0, -1.0)):
            mass = labelled[label, part].copy()
            if pseudo is not None and (n := pseudo[label, part].sum()):
                mass += pseudo[label, part] * min(1.0, mass.sum() / n)
            scale = max(1e-9, mass.sum())
            odds = odds + sign * np.log((mass + SMOOTH * scale / (scale + len(mass))) / (scale * (1 + SMOOTH)))
        out.append(View(np.clip(odds, -6, 6)))
    return out[0], out[1]


def _raws(packed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_from_json(packed)
        for b in batches:
            for at, f in features(b.column("text"), b.column("source").to_pylist(), b.column("lang").to_pylist()):
                t, m = model.text.raw(f), model.meta.raw(f)
                yield pa.RecordBatch.from_arrays([b.column("quality").slice(at, f.n), *[pa.array(x) for x in (t[:, 1], m[:, 1], t[:, 2])]], names=["quality", "t", "m", "s"])
        trim()

    return run


def calibrated(views: tuple[View, View], spare: DataFrame) -> Model:
    """A model of the two views; spare has a part of LABELLED rows, of which four numbers each come here."""
    plain = Model(*views, [0.0, 0.0, 0.0])
    rows = spare.mapInArrow(_raws(plain.to_json()), "quality int, t double, m double, s double").toPandas().sort_values(["quality", "t", "m", "s"])
    y, one = rows["quality"].to_numpy(float), np.ones(len(rows))
    logits = [one]
    for view, c in zip(views, "tm"):
        raw = np.column_stack([one, rows[c], rows["s"]])
        view.coef = regression(raw, y)
        logits.append(view.logit(raw))
    return Model(*views, regression(np.column_stack(logits), y))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality and spare of the labelled rows that fitting takes. Labels are learnt only where
    crc32 of the doc_id as text, modulo 4, is not 2."""
    may = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & may).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    spare = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0
    return cut(picked.where("quality IN (0, 1)").withColumn("spare", spare), "quality-sample")


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Model:
    """docs: doc_id, text, source, lang."""
    picked = F.broadcast(sample(docs, labels))  # at most LABELLED rows of three values
    own = cut(docs.join(picked, "doc_id"), "labelled-documents")
    kinds = {(r.spare, r.quality) for r in own.select("spare", "quality").distinct().collect()}
    if len(kinds) < 4:
        return EVEN
    spare, pool = own.where("spare"), docs.join(picked, "doc_id", "left_anti")
    labelled = counts(own.where("NOT spare"))
    model = calibrated(train(labelled), spare)
    for _ in range(rounds):
        model = calibrated(train(labelled, counts(pool, model)), spare)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score, predicted of every document; scores are
    probabilities of good quality."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    model = fit(rows, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model.to_json())  # TEXT_CELLS + META_CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_from_json(shared.value)
        for b in batches:
            for at, f in features(b.column("text"), b.column("source").to_pylist(), b.column("lang").to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, f.n), *map(pa.array, own.score(f))], names=["doc_id", "text_score", "meta_score", "score"])
        trim()

    out = rows.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
