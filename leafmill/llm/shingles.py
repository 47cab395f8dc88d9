"""Hashes of words and word shingles for whole Arrow batches of texts, with numpy.

Words are the runs of bytes other than the six ASCII white-space bytes, found and hashed without a
Python object for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one round of numpy calls handles, about; longer texts come alone.
CHUNK_BYTES = 2 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15 | 1, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, byte offsets, bytes) of runs of rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offs, data = texts.buffers()
    ends = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK_BYTES, "right")) - 1)
        yield row, ends[row : stop + 1] - ends[row], all_bytes[ends[row] : ends[stop]]
        row = stop


def words(ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the place of each row's first word (rows + 1 places)."""
    solid = (data != 32) & ((data < 9) | (data > 13))
    before = np.empty_like(solid)
    if len(solid) == 0:
        return np.empty(0, _U), np.zeros(len(ends), np.int64)
    before[0] = False
    before[1:] = solid[:-1]
    edges = ends[:-1]
    before[edges[edges < len(data)]] = False
    starts = np.flatnonzero(solid & ~before)
    if len(starts) == 0:
        return np.empty(0, _U), np.zeros(len(ends), np.int64)
    first = np.searchsorted(starts, ends)
    letters = data[solid].astype(_U)
    lengths_at = np.cumsum(solid)[starts] - 1  # each word's first place among the letters
    lengths = np.diff(lengths_at, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(lengths_at, lengths)
    letters += _U(1)
    letters *= _powers(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(letters, lengths_at)), first


def shingles(ends: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and the row of each. A row of fewer words, but one at least, has
    one shingle of all its words."""
    h, first = words(ends, data)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    factor = _powers(n + 1)[1:]
    if len(h) >= n:
        inside = row[: len(h) - n + 1] == row[n - 1 :]
        total = h[: len(h) - n + 1] * factor[0]
        for k in range(1, n):
            total += h[k : len(h) - n + 1 + k] * factor[k]
        out, rows = mix(total[inside]), row[: len(h) - n + 1][inside]
    else:
        out, rows = np.empty(0, _U), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = []
        for r in short:
            w = h[first[r] : first[r + 1]]
            extra.append(np.add.reduce(w * factor[: len(w)]) + _U(len(w)))
        out = np.concatenate([out, mix(np.array(extra, _U))])
        rows = np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def distinct(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) in order, with counts."""
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    if len(h) == 0:
        return h, rows, np.empty(0, np.int64)
    new = np.empty(len(h), bool)
    new[0] = True
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return h[at], rows[at], np.diff(at, append=len(h))
