"""Cross-entropy difference of documents under a target and a background language model.

Both models are interpolated bigram models of the same order and smoothing over one vocabulary, all
distinct words of the corpus: words and word pairs are told apart by 64-bit hashes, and every one of
them is kept, so the models grow with the corpus. All documents count: the background model is counted
over all rows, the target model over all target rows. Background counts are scaled to the target's number of words, so that both models back off
alike (Moore and Lewis, 2010, match the models by drawing a background sample of that size).

A document is scored by the mean over its words of target loss minus background loss, in nats; less
means more like the target. Its own words are taken out of both models first, so that no document
is scored by a model that has learnt it.

No task holds a whole model. Documents are written in chunks of about CHUNK_TEXT bytes; a chunk sends
its distinct words and pairs, once each with their counts there, to buckets by ranges of the hash,
of which there are more the larger the corpus is. A bucket sums each key over all chunks and
sends every chunk the sums of its own keys, and a chunk's documents are scored with those. A pair
that stands everywhere comes once from a chunk, so none makes a bucket large.

Defined cases: null and empty texts have no words, null losses and a null score; without target
words both models are the same and scores are 0; a null target mark counts as false; repeated rows
count as often as they stand, and each is scored without its own words only; an empty table gives
an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import cut, small_side, trim

#: Bytes of text that make a chunk, and bytes for which the corpus gets one more bucket of keys.
CHUNK_TEXT, BUCKET_TEXT = 8 << 20, 8 << 20
#: Weight of the word model against a pair's count, and of the even distribution in the word model.
BACK_OFF, EVEN = 4.0, 0.5
_U = np.uint64
_START = _U(0x51A2C0FFEE)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the greatest needs: the width, then all first bytes, all
    second bytes and so on."""
    x = x.astype("<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _wide(x: bytes) -> np.ndarray:
    width = x[0]
    out = np.zeros(((len(x) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(x, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<u8").ravel()


def _keys(x: np.ndarray) -> bytes:
    """Rising keys: the first, then the steps."""
    return x[:1].astype("<u8").tobytes() + _narrow(np.diff(x))


def _read_keys(x: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(x, "<u8", 1), _wide(x[8:])]), dtype=_U)


_CHUNK = "chunk long, doc_id array<long>, target array<boolean>, size long, ends binary, text binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in chunks of about CHUNK_TEXT bytes, one row each, with the text compressed."""
    part, at = TaskContext.get().partitionId() << 32, 0
    ids, marks, sizes, texts, held = [], [], [], [], 0

    def row() -> pa.RecordBatch:
        text = pa.Codec("zstd", compression_level=5).compress(b"".join(texts), asbytes=True)
        ends = _narrow(np.concatenate(sizes))
        return pa.RecordBatch.from_arrays([
            pa.array([part + at]), pa.array([ids], pa.list_(pa.int64())), pa.array([marks], pa.list_(pa.bool_())),
            pa.array([held]), pa.array([ends], pa.binary()), pa.array([text], pa.binary()),
        ], names=["chunk", "doc_id", "target", "size", "ends", "text"])

    for batch in batches:
        for first, ends, data in sh.chunks(batch.column("text")):
            ids += batch.column("doc_id").slice(first, len(ends) - 1).to_pylist()
            marks += batch.column("target").slice(first, len(ends) - 1).to_pylist()
            sizes.append(np.diff(ends))
            texts.append(data.tobytes())
            held += len(data)
            if held >= CHUNK_TEXT:
                yield row()
                at += 1
                ids, marks, sizes, texts, held = [], [], [], [], 0
    if ids:
        yield row()
    trim()


def _words(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a chunk, and the number of words of each document."""
    data = pa.decompress(row["text"], decompressed_size=row["size"], codec="zstd") if row["size"] else pa.py_buffer(b"")
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(_wide(row["ends"]), dtype=np.int64)])
    texts = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), data)
    found = [sh.words(e, d) for _, e, d in sh.chunks(texts)]
    return np.concatenate([h for h, _ in found]), np.concatenate([np.diff(first) for _, first in found])


def _pairs(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair of every word with the one before, and the places of the documents' first words,
    which follow a start mark."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = _START
    return sh.mix(h * _U(0x9E3779B97F4A7C15) + before), starts


def _split(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of rising keys; the bucket rises with the key."""
    bucket = ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    return [(int(bucket[x]), int(x), int(y)) for x, y in zip([0, *cuts], [*cuts, len(keys)]) if x < y]


def _batches(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 500):
        yield pa.RecordBatch.from_pylist(rows[k : k + 500], schema=schema)


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with the same key."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[by] != key:
                yield key, held
                held = []
            key = row[by]
            held.append(row)
    if held:
        yield key, held


def _list_words(buckets: int):
    """(bucket, a, n, t): a chunk's distinct words by bucket; its words and those of target rows
    stand in the first row."""
    schema = pa.schema([("bucket", pa.int64()), ("a", pa.binary()), ("n", pa.int64()), ("t", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, counts = _words(row)
                words = np.unique(h)
                out = [{"bucket": k, "a": _keys(words[x:y]), "n": 0, "t": 0} for k, x, y in _split(words, buckets)]
                if out:
                    out[0] |= {"n": len(h), "t": int(counts[np.array(row["target"], bool)].sum())}
                yield from _batches(out, schema)
        trim()

    return run


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _groups(batches, "bucket"):
        words = len(np.unique(np.concatenate([_read_keys(r["a"]) for r in rows])))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (words, sum(r["n"] for r in rows), sum(r["t"] for r in rows))], names=["words", "n", "t"])
    trim()


def totals(chunks: DataFrame, buckets: int, parts: int) -> tuple[int, int, int]:
    """Distinct words, words, and words of target rows."""
    listed = chunks.mapInArrow(_list_words(buckets), "bucket long, a binary, n long, t long").repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = listed.mapInArrow(_distinct, "words long, n long, t long").agg(F.sum("words"), F.sum("n"), F.sum("t")).first()
    return tuple(int(x or 0) for x in found)


_ASKED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_ASKED_DDL = "bucket long, chunk long, a binary, b binary, c binary"


def _ask(buckets: int):
    """A chunk's distinct keys by bucket (a), and how often they stand in all its rows (b) and in its
    target rows (c). Buckets of pairs follow those of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, counts = _words(row)
                marks = np.array(row["target"], bool)
                own = np.repeat(marks, counts)
                pair, starts = _pairs(h, counts)
                word = np.concatenate([h, np.full(len(starts), _START, _U)])
                for base, x, target in ((0, word, np.concatenate([own, marks[counts > 0]])), (buckets, pair, own)):
                    keys, place = np.unique(x, return_inverse=True)
                    n = np.bincount(place, minlength=len(keys))
                    t = np.bincount(place, target, len(keys))
                    out = [{"bucket": base + k, "chunk": row["chunk"], "a": _keys(keys[i:j]), "b": _narrow(n[i:j]), "c": _narrow(t[i:j])} for k, i, j in _split(keys, buckets)]
                    yield from _batches(out, _ASKED)
        trim()

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket: every chunk's keys get their sums over all chunks, b: all rows, c:
    target rows."""
    for bucket, rows in _groups(batches, "bucket"):
        parts = [_read_keys(r["a"]) for r in rows]
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        n, t = (np.bincount(at, np.concatenate([_wide(r[c]) for r in rows]), len(keys))[at].astype(np.int64) for c in ("b", "c"))
        cuts = np.cumsum([len(x) for x in parts])[:-1]
        out = [{"bucket": bucket, "chunk": r["chunk"], "b": _narrow(x), "c": _narrow(y)} for r, x, y in zip(rows, np.split(n, cuts), np.split(t, cuts))]
        yield from _batches(out, _ASKED)
    trim()


def _losses(counts: np.ndarray, total: float, scale: float, vocabulary: int, word: np.ndarray, before: np.ndarray, pair: np.ndarray, own: tuple, used: np.ndarray) -> np.ndarray:
    """-log p of every word. own: how often the document itself has the word, the word before, the
    pair, and any word; used: 1 for the words of documents that the model has counted."""
    of = lambda cell, mine: np.maximum(counts[cell] - mine * used, 0.0) * scale
    w, b, p = (of(x, y) for x, y in zip((word, before, pair), own[:3]))
    whole = np.maximum(total - own[3] * used, 0.0) * scale
    single = (w + EVEN) / (whole + EVEN * max(1, vocabulary))
    return -np.log((np.minimum(p, b) + BACK_OFF * single) / (b + BACK_OFF))


def _repeats(row: np.ndarray, cell: np.ndarray, size: int) -> np.ndarray:
    """How often each word's cell stands in its row."""
    _, place, counts = np.unique(row * size + cell, return_inverse=True, return_counts=True)
    return counts[place]


def _judge(vocabulary: int, all_words: int, target_words: int):
    """Rows in order of chunk and bucket: the scores of each chunk's documents."""

    def losses(head: dict, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, n = _words(head)
        if not target_words:
            return n, np.zeros(len(n)), np.zeros(len(n))
        pairs, starts = _pairs(h, n)
        words, word = np.unique(np.concatenate([h, np.full(len(starts), _START, _U)]), return_inverse=True)
        distinct, pair = np.unique(pairs, return_inverse=True)
        background, target = (np.concatenate([np.zeros(0), *[_wide(r[c]) for r in rows]]) for c in ("b", "c"))
        if len(background) != len(words) + len(distinct):
            raise RuntimeError(f"chunk {head['chunk']} has counts of {len(background)} keys, not {len(words) + len(distinct)}")
        row, mark = np.repeat(np.arange(len(n)), n), word[-1] if len(starts) else 0
        word = word[: len(h)]
        inner = np.ones(len(word), bool)
        inner[starts] = False
        inner = np.flatnonzero(inner)
        before = np.full(len(word), mark)
        before[inner] = word[inner - 1]
        own_word = _repeats(row, word, len(words))
        # the word before has its own count there; a start mark stands once
        own_before = np.ones_like(own_word)
        own_before[inner] = own_word[inner - 1]
        own = (own_word, own_before, _repeats(row, pair, len(distinct)), n[row])
        at = (word, before, len(words) + pair, own)
        marks = np.array(head["target"], float)[row]
        loss_t = _losses(target, target_words, 1.0, vocabulary, *at, marks)
        loss_b = _losses(background, all_words, target_words / all_words, vocabulary, *at, np.ones(len(row)))
        return n, np.bincount(row, loss_t, len(n)), np.bincount(row, loss_b, len(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (head, *rows) in _groups(batches, "chunk"):
            n, t, b = losses(head, rows)
            none = n == 0
            mean = [pa.array(np.where(none, 0.0, x / np.maximum(n, 1)), mask=none) for x in (t, b, t - b)]
            yield pa.RecordBatch.from_arrays([pa.array(head["doc_id"], pa.int64()), pa.array(head["target"], pa.bool_()), pa.array(n, pa.int64()), *mean], names=["doc_id", "target", "n_words", "target_loss", "background_loss", "score"])
        trim()

    return run


def score(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, target) to doc_id, target, n_words, target_loss, background_loss, score: losses are means
    over the words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("target", F.lit(False)).alias("target"))
    chunks = cut(rows.mapInArrow(_chunks, _CHUNK), "text-chunks")
    buckets = (chunks.agg(F.sum("size")).first()[0] or 0) // BUCKET_TEXT + 1
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, buckets)
    asked = chunks.mapInArrow(_ask(buckets), _ASKED_DDL).repartition(parts, "bucket").sortWithinPartitions("bucket")
    told = asked.mapInArrow(_answer, _ASKED_DDL).drop("a").unionByName(chunks.withColumn("bucket", F.lit(-1).cast("long")), allowMissingColumns=True)
    told = told.repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket")
    return told.mapInArrow(_judge(*totals(chunks, buckets, parts)), "doc_id long, target boolean, n_words long, target_loss double, background_loss double, score double")


def with_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and target: the documents that a label calls good."""
    good = cut(labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct(), "target-documents")
    marked = docs.select("doc_id", "text").join(small_side(good.select(F.col("doc_id").alias("__good")), 16), F.col("doc_id") == F.col("__good"), "left")
    return marked.select("doc_id", "text", F.col("__good").isNotNull().alias("target"))
