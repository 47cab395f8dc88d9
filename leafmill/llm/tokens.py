"""Token ids of whole texts through a public tokenizer file, word by word with a bounded cache.

The word-end BPE drops white space and never lets a token reach across it, so a text's ids are the
ids of its space-separated parts in order. Parts repeat far more often than texts: each worker
numbers the parts that it has seen, keeps their ids in one array and only encodes new ones; a text
then is one lookup a part and one gather.
"""

from __future__ import annotations

import os
import string
from itertools import chain

import numpy as np

from .common import keeps

#: Parts that a worker keeps, about 200 bytes each; beyond it the cache starts anew.
CACHE_PARTS = 400_000
#: Characters that are split at a time.
SLICE_CHARS = 1 << 20
_TAIL = string.punctuation.replace("'", "")
#: Letters below it, but for the dotted capital I, are a single code point to every step of the tokenizer:
#: normalisation leaves them alone and lower case goes letter by letter.
_PLAIN = "\u0250"
_END = "</w>"


class _Index(dict):
    """Numbers its keys in order of first lookup and lists those it hadn't."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


class WordTokenizer:
    def __init__(self, path: str, cache_parts: int = CACHE_PARTS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._limit = cache_parts
        vocab = self._tok.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self._ends[i] = token.endswith(_END)
        self._reset()

    def _reset(self) -> None:
        self._index = _Index()
        self._start, self._size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._ids, self._used = np.zeros(4096, "<u4"), 0

    def _put(self, numbers: list[int] | np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Append the ids of many parts, which end at ``ends``."""
        n = len(ids)
        if self._used + n > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(len(self._ids) + n, "<u4")])
        if len(self._index) > len(self._start):
            more = np.zeros(len(self._index), np.int64)
            self._start, self._size = np.concatenate([self._start, more]), np.concatenate([self._size, more])
        self._ids[self._used : self._used + n] = ids
        size = np.diff(ends, prepend=0)
        self._size[numbers] = size
        self._start[numbers] = self._used + ends - size
        self._used += n

    def _encode(self, numbers: list[int], parts: list[str]) -> None:
        if parts:
            ids = [e.ids for e in self._tok.encode_batch(parts, add_special_tokens=False)]
            self._put(numbers, np.fromiter(chain.from_iterable(ids), "<u4"), np.cumsum([len(x) for x in ids]))

    def _encode_letters(self, numbers: list[int], parts: list[str], step: int = 1000) -> None:
        """Parts of plain lower-case letters are encoded a thousand at a time: each is one word to the
        tokenizer and ends in one word-end id."""
        at = range(0, len(parts), step)
        joined = self._tok.encode_batch([" ".join(parts[i : i + step]) for i in at], add_special_tokens=False)
        for i, e in zip(at, joined):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(parts[i : i + step]):
                raise RuntimeError("the tokenizer does not end every word in one word-end id")
            self._put(numbers[i : i + step], ids, ends)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts one after another, and where each part's end."""
        size = self._size[numbers]
        ends = np.cumsum(size)
        return self._ids[np.repeat(self._start[numbers] - (ends - size), size) + np.arange(int(ends[-1]))], ends

    def _learn(self) -> None:
        """Ids for all new parts: plain letters with punctuation behind them, or in upper case, are put
        together from simpler parts; every other part is encoded as it is."""
        index, new = self._index, self._index.new
        number = len(index) - len(new)
        letters, odd, made, pieces = ([], []), ([], []), [], []
        for part in new:  # grows meanwhile
            core = part.rstrip(_TAIL)
            if core.isalpha() and (core.isascii() or (max(core) < _PLAIN and "\u0130" not in core)):
                low = core.lower()
                if low == part:
                    letters[0].append(number)
                    letters[1].append(part)
                else:
                    made.append(number)
                    pieces += (index[low], index[part[len(core) :]])
            else:
                odd[0].append(number)
                odd[1].append(part)
            number += 1
        index.new = []
        self._encode_letters(*letters)
        self._encode(*odd)
        if made:
            ids, ends = self._gather(np.array(pieces))
            self._put(made, ids, ends[1::2])

    def _slice(self, texts: list[str]) -> list[bytes]:
        if len(self._index) > self._limit:
            self._reset()
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        flat = np.fromiter(map(self._index.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        if self._index.new:
            self._learn()
        ids, upto = self._gather(flat)
        data = ids.tobytes()
        ends = (4 * upto[np.cumsum(counts) - 1]).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit little-endian bytes."""
        out: list[bytes] = []
        held, chars = [], 0
        for t in texts:
            held.append(t)
            chars += len(t)
            if chars >= SLICE_CHARS:
                out += self._slice(held)
                held, chars = [], 0
        return out + self._slice(held) if held else out


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(name_or_path: str) -> WordTokenizer:
    """One tokenizer for each Python worker and file. A bare name is looked up among the public
    tokenizers that the worker has installed."""
    keeps("tokens", _loaded.clear)
    if name_or_path not in _loaded:
        path = name_or_path
        if os.sep not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        _loaded[name_or_path] = WordTokenizer(path)
    return _loaded[name_or_path]
