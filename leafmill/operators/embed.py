"""Embedders: a hashing one without a model, a window for neural ones, and a registry."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.kernels import tokens
from ..functions.text import py_tokens

#: (texts) -> one vector each
Encode = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class Embedder:
    """A name, a width, a longest input (None: any) and how a worker gets the encoder."""

    name: str
    backend: str
    dimensions: int
    load: Callable[[], Encode]
    max_length: int | None = None
    device: str = "CPU"


def features(text: str) -> Iterator[str]:
    """Tokens, their letter trigrams between angle brackets, and pairs of neighbours."""
    toks = py_tokens(text)
    for t in toks:
        yield f"tok:{t}"
        edge = f"<{t}>"
        yield from (f"tri:{edge[i:i + 3]}" for i in range(len(edge) - 2))
    yield from (f"bi:{a} {b}" for a, b in zip(toks, toks[1:]))


#: Features of a kind whose digests a worker keeps; then it begins anew.
KEPT = 100_000


class _Digests(dict):
    """The digests of features of one kind, made when they are asked for first. ``start`` has the
    kind's prefix and the digest's parameters already, which copying is quicker than giving them again."""

    def __init__(self, prefix: bytes) -> None:
        self.start = hashlib.blake2b(prefix, digest_size=8)

    def digest(self, f: str) -> bytes:
        h = self.start.copy()
        h.update(f.encode())
        return h.digest()

    def __missing__(self, f: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        made = self[f] = self.digest(f)
        return made


class _Tokens(_Digests):
    """A token's digest and those of its trigrams."""

    def __init__(self) -> None:
        super().__init__(b"tok:")
        self.trigrams = _Digests(b"tri:")

    def digest(self, f: str) -> bytes:
        edge = f"<{f}>"
        return super().digest(f) + b"".join([self.trigrams[edge[i : i + 3]] for i in range(len(edge) - 2)])


def hash_encoder(dimensions: int) -> Encode:
    """Signed feature hashing over ``features``: bits of a BLAKE2b digest choose the place and the sign."""
    of_token, of_pair = _Tokens(), _Digests(b"bi:")

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for row, t in zip(out, texts):
            toks = tokens(t)
            found = [of_token[x] for x in toks]
            found += [of_pair[f"{a} {b}"] for a, b in zip(toks, toks[1:])]
            v = np.frombuffer(b"".join(found), "<u8")
            codes = (2 * (v % np.uint64(dimensions)) + (v >> np.uint64(8) & np.uint64(1))).astype(np.int64)
            counts = np.bincount(codes, minlength=2 * dimensions)
            row += counts[1::2] - counts[::2]
            length = np.sqrt((row * row).sum())
            if length:
                row /= length
        return out

    return encode


def hashing(dimensions: int = 256) -> Embedder:
    return Embedder(f"hashing-ngram-{dimensions}", "hashing-ngram", dimensions, lambda: hash_encoder(dimensions))


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Token states averaged over the mask, and scaled to length 1: what a neural encoder ends in."""
    weights = mask[..., None].astype("float32")
    pooled = (states * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1e-9)
    return (pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)).astype("float32")


def batched(encode_batch: Encode, batch: int) -> Encode:
    """For encoders of a fixed batch: the last one is filled up with empty texts."""

    def encode(texts: list[str]) -> np.ndarray:
        out = []
        for i in range(0, len(texts), batch):
            part = texts[i : i + batch]
            out.append(encode_batch(part + [""] * (batch - len(part)))[: len(part)])
        return np.concatenate(out) if out else np.zeros((0, 0))

    return encode


#: Texts that are encoded at a time.
_SLICE = 512

_REGISTRY: dict[str, Callable[..., Embedder]] = {}
_ALIASES = {"hash": "hashing-ngram", "hashing": "hashing-ngram", "ngram": "hashing-ngram", "default": "hashing-ngram"}


def register(backend: str, make: Callable[..., Embedder]) -> None:
    _REGISTRY[backend] = make


register("hashing-ngram", hashing)


def create(backend: str = "hashing-ngram", **settings) -> Embedder:
    name = backend.strip().lower().replace("_", "-")
    name = _ALIASES.get(name, name)
    if name not in _REGISTRY:
        raise ValueError(f"unknown embedding backend: {backend}")
    return _REGISTRY[name](**settings)


def embed(embedder: Embedder, text: Column) -> Column:
    """The vector of each text; a worker loads the encoder once for a stream of batches."""
    load = embedder.load

    @F.arrow_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()
        for s in batches:
            parts = [pa.array([], pa.list_(pa.float32()))]
            for at in range(0, len(s), _SLICE):  # neither texts nor vectors of a whole batch stand in Python
                found = encode([t or "" for t in s.slice(at, _SLICE).to_pylist()]).astype("float32")
                ends = np.arange(len(found) + 1, dtype="int32") * found.shape[1]
                parts.append(pa.ListArray.from_arrays(ends, found.ravel()))
            yield pa.concat_arrays(parts)

    return run(text)
