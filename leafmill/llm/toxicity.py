"""Toxicity scores from a learnt lexicon, matched by Levenshtein automata, and context windows.

Fitting (on a bounded sample of labelled rows): the words and stems that mark toxic documents
become the lexicon, with log-odds as weights; what is copied from one document to another counts
once, so that what a copied document happens to say does not count as a mark. A logistic regression over a document's hits
then gives its score.

Scoring: every word of the text is matched with the lexicon trie, misspelled terms of FUZZY letters and
misspelled stems of FUZZY_STEM letters within an edit, unless clean texts have a word within an edit of
the term: such a term counts only as it is written. A hit in quotation marks, in a quoted line or
beside a reporting verb counts less than one that stands by itself or addresses the reader.

Defined cases: null and empty texts have no hits and score as such; very long texts are scored whole; without labelled rows of both
kinds the seed lexicon and fixed coefficients apply; labels with a null are skipped, and a document
with several labels is toxic if one of them says so; repeated rows score alike; extra columns pass
through ``score_column`` unread.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keeps, trim
from .levenshtein import Lexicon

#: Labelled rows that fitting takes at most, those with the smallest hashes of doc_id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Bytes of text that fitting takes at most of either kind; a text that would go beyond is left out.
SAMPLE_BYTES = 64 << 20
#: Letters from which on a term, or a stem, may be misspelled.
FUZZY, FUZZY_STEM = 5, 7
#: What a misspelled term counts of the term. The regression may correct it where training texts have some.
MISSPELLED = 0.8
THRESHOLD = 0.3
SEED = ("idiot", "moron", "stupid", "scum", "worthless", "disgusting")
SEED_WEIGHT = 3.0
#: Evidence that a term needs: toxic documents, log-odds, and twice the log-likelihood ratio.
MIN_DOCS, MIN_SHARE, MIN_ODDS, MIN_G = 3, 0.01, 3.0, 16.0
STEMS = range(3, 9)
#: Words on either side of a hit that its context is read from.
WINDOW = 6
#: Words known to match nothing that a worker remembers.
CACHE_WORDS = 300_000

_TOKEN = re.compile(r"\w(?:[\w@$!*]*\w)?")
_LEET = str.maketrans("013457@$!", "oieastasi")
_QUOTES = "\"“”«»„‟‘’'"
_REPORT = frozenset("said says say wrote writes called calls quote quoted quotes word words term sagte sagt schrieb nannte zitat wort dit disait écrit appelé mot citation dijo dice escribió llamó palabra cita".split())
_YOU = frozenset("you your youre yours u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
_DEFAULT = [-3.0, 2.0, 0.5, 0.5, 0.0, 0.0]


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Model:
    def __init__(self, weights: dict[str, float], exact: list[str], coef: list[float]) -> None:
        """exact: terms that are not looked for misspelled."""
        self.weights, self.exact, self.coef = weights, frozenset(exact), coef
        edits = {t: int(t not in self.exact and len(t.rstrip("*")) >= (FUZZY_STEM if t.endswith("*") else FUZZY)) for t in weights}
        self.lexicon = Lexicon(edits)
        self._clean: set[str] = set()
        self._hit: dict[str, tuple[str, int]] = {}

    def match(self, token: str) -> tuple[str, int] | None:
        """The best term for a token: of those with the fewest edits the heaviest."""
        for form in dict.fromkeys((token, token.translate(_LEET))):
            if self.lexicon.possible(form):
                found = self.lexicon.search(form)
                if found:
                    return min(found, key=lambda x: (x[1], -self.weights[x[0]]))
        return None

    def hits(self, text: str) -> list[tuple[str, int, bool, bool]]:
        """(term, edits, quoted, addressed) of each hit, in order."""
        words = set(tokens(text)) if text else set()
        here = set()
        for w in words - self._clean:
            if w not in self._hit:
                found = self.match(w)
                if found is None:
                    if len(self._clean) >= CACHE_WORDS:
                        self._clean = set()
                    self._clean.add(w)
                    continue
                self._hit[w] = found
            here.add(w)
        if not here:
            return []
        low = text.lower()
        spans = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(low)]
        marks = [i for i, c in enumerate(low) if c == '"'] if '"' in low else []
        ends = [i for i, c in enumerate(low) if c == "\n"] if "\n" in low else []
        out = []
        for i, (w, a, b) in enumerate(spans):
            if w in here:
                around = {x[0] for x in spans[max(0, i - WINDOW) : i]} | {x[0] for x in spans[i + 1 : i + 1 + WINDOW]}
                n = bisect_left(ends, a)
                line, stop = ends[n - 1] + 1 if n else 0, ends[n] if n < len(ends) else len(low)
                open_, shut = bisect_left(marks, line), bisect_left(marks, a)
                quoted = (
                    low[max(0, a - 1) : a] in _QUOTES and a > 0
                    or low[line : line + 1] == ">"
                    or (shut - open_) % 2 == 1 and marks[shut:] and marks[shut] < stop
                    or bool(around & _REPORT)
                )
                out.append((*self._hit[w], quoted, bool(around & _YOU)))
        return out

    def features(self, text: str) -> list[float]:
        plain, quoted, fuzzy, top, terms = 0.0, 0.0, 0.0, 0.0, set()
        for term, edits, said, you in self.hits(text):
            w = self.weights[term] * (MISSPELLED if edits else 1.0)
            if edits:
                fuzzy += w
            if said:
                quoted += w
            else:
                plain += w * (1.25 if you else 1.0)
                top = max(top, w)
                terms.add(term)
        return [1.0, math.log1p(plain), top / 5, math.log1p(len(terms)), math.log1p(quoted), math.log1p(fuzzy)]

    def score(self, text: str | None) -> float:
        z = sum(c * x for c, x in zip(self.coef, self.features(text or "")))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def to_json(self) -> str:
        return json.dumps([self.weights, sorted(self.exact), self.coef])


_models: dict[str, Model] = {}


def model_from_json(text: str) -> Model:
    """One model for each worker, so that what it knows of words outlives a task."""
    keeps("toxicity", _models.clear)
    if text not in _models:
        _models.clear()
        _models[text] = Model(*json.loads(text))
    return _models[text]


def learn_terms(toxic: list[list[str]], clean: list[list[str]]) -> dict[str, float]:
    """Words and stems* that mark the toxic documents, with their log-odds.

    A term's support is the least of its toxic documents and of the different pairs of neighbours
    that it has in them: what stands in copies or in a passage that many documents share has the
    same neighbours everywhere and counts once.
    """
    sets = [set(d) for d in toxic]
    words, stems = Counter(), Counter()
    for s in sets:
        words.update(s)
        stems.update({w[:n] for w in s for n in STEMS if len(w) > n})
    n_pos, n_neg = len(toxic), max(1, len(clean))
    least = max(MIN_DOCS, MIN_SHARE * n_pos)
    words = {t: n for t, n in words.items() if n >= least and len(t) >= 3}
    stems = {t: n for t, n in stems.items() if n >= least}
    not_words, not_stems = Counter(), Counter()
    for d in clean:
        s = set(d)
        not_words.update([w for w in s if w in words])
        not_stems.update({t for w in s for n in STEMS if len(w) > n and (t := w[:n]) in stems})
    share = n_pos / (n_pos + n_neg)

    def evidence(p: float, n: float) -> tuple[float, float]:
        odds = math.log((p + 0.5) / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1))
        g = 2 * (p * math.log(p / ((p + n) * share)) + (n * math.log(n / ((p + n) * (1 - share))) if n else 0.0))
        return odds, g

    def marks(pos: dict, neg: Counter) -> set[str]:
        return {t for t, p in pos.items() if (e := evidence(p, neg[t]))[0] >= MIN_ODDS and e[1] >= MIN_G}

    words_left, stems_left = marks(words, not_words), marks(stems, not_stems)
    near: dict[str, set[int]] = {}
    forms: dict[str, set[str]] = {}
    for d in toxic:
        around = ["", *d, ""]
        for i, w in enumerate(d):
            if w in words_left:
                near.setdefault(w, set()).add(hash((around[i], around[i + 2])))
            for n in STEMS:
                if len(w) > n and (t := w[:n]) in stems_left:
                    near.setdefault(t + "*", set()).add(hash((around[i], around[i + 2])))
                    forms.setdefault(t, set()).add(w)
    found = []
    for pos, neg, left, mark in ((words, not_words, words_left, ""), (stems, not_stems, stems_left, "*")):
        for t in left:
            p = min(pos[t], len(near[t + mark]))
            if p < least or mark and (len(forms[t]) < 4 or max(words.get(w, 0) for w in forms[t]) > 0.6 * pos[t]):
                continue  # too few places, or one word rather than a family of words
            odds, g = evidence(p, neg[t])
            if odds >= MIN_ODDS and g >= MIN_G:
                found.append((-g, -len(t), t + mark, odds))
    kept: dict[str, float] = {}
    for _, _, t, odds in sorted(found):
        word = t.rstrip("*")
        if not any(word.startswith(k.rstrip("*")) and k.endswith("*") or t.endswith("*") and k.startswith(word) for k in kept):
            kept[t] = round(odds, 4)
    return kept


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> list[float]:
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return [round(float(b), 6) for b in beta]


def fit_rows(texts: list[str], labels: list[int], odds: float | None = None) -> Model:
    """A model from labelled texts; odds of toxic documents among all labelled ones, if the
    texts are a sample that is not in proportion."""
    seen: dict[tuple[str, int], None] = dict.fromkeys(zip(texts, labels))
    texts, labels = [t for t, _ in seen], [y for _, y in seen]
    split = [tokens(t) for t in texts]
    toxic = [s for s, y in zip(split, labels) if y]
    clean = [s for s, y in zip(split, labels) if not y]
    if not toxic or not clean:
        return Model(dict.fromkeys(SEED, SEED_WEIGHT), [], _DEFAULT)
    weights = learn_terms(toxic, clean)
    known = set().union(*clean)
    for w in SEED:
        if w not in known:
            weights.setdefault(w, SEED_WEIGHT)
    draft = Model(weights, [], _DEFAULT)
    exact = sorted({t for w in known if draft.lexicon.possible(w) for t, edits in draft.lexicon.search(w) if edits})
    draft = Model(weights, exact, _DEFAULT)
    x = np.array([draft.features(t) for t in texts])
    y = np.array(labels, float)
    ratio = odds if odds else len(toxic) / len(clean)
    weight = np.where(y == 1, ratio * len(clean) / len(toxic), 1.0)
    return Model(weights, exact, _regression(x, y, weight))


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """(text, toxic, odds) of the labelled rows that may be learnt from: crc32 of the doc_id as text,
    modulo 4, is not 2."""
    may = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & may).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = cut(own, "labels")
    counts = own.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    odds = counts[0] / counts[1] if counts[1] else 0.0
    by = [F.xxhash64("doc_id"), "doc_id"]
    picked = own.where("toxic = 1").orderBy(*by).limit(toxic).unionByName(own.where("toxic = 0").orderBy(*by).limit(clean))
    picked = cut(picked, "sample")  # at most toxic + clean rows of two numbers
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sizes = found.groupBy("doc_id", "toxic").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    upto = F.sum("size").over(Window.partitionBy("toxic").orderBy(*by))  # at most toxic or clean rows of three numbers
    within = sizes.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("doc_id")
    return found.join(F.broadcast(within), "doc_id").select("text", "toxic", F.lit(float(odds)).alias("odds"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits in one task, on the bounded sample; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks, odds = [], [], 0.0
        for b in batches:
            texts += [t or "" for t in b.column("text").to_pylist()]
            marks += b.column("toxic").to_pylist()
            odds = b.column("odds")[0].as_py() if b.num_rows else odds
        yield pa.RecordBatch.from_arrays([pa.array([fit_rows(texts, marks, odds).to_json()])], names=["model"])

    rows = training_rows(docs, labels).repartition(1).mapInArrow(run, "model string").collect()
    return model_from_json(rows[0][0]) if rows else fit_rows([], [])


def score_column(model: Model, text: str | Column = "text") -> Column:
    """The score as a column: no shuffle, and the row's other columns stay."""
    packed = model.to_json()

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model_from_json(packed)
        for s in batches:
            yield pd.Series([own.score(t) for t in s], dtype="float64")
        trim()

    return scores(text)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)
    out = docs.select("doc_id", score_column(model).alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs that score below the threshold, with their columns."""
    return docs.where(score_column(fit(docs, labels)) < threshold)
