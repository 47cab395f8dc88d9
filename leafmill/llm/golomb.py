"""Golomb-Rice coding of sorted 64-bit hashes, and bitmaps, with numpy."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BIQ")


def encode(values: np.ndarray, base: int = 0) -> bytes:
    """Code sorted distinct uint64 values as gaps from base.

    Each gap g is split into a quotient g >> k in unary (one stream) and a remainder of k bits
    (another stream); k follows the mean gap, which makes the code near-optimal for hashes.
    """
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    if n == 0:
        return _HEAD.pack(0, 0, base)
    gaps = np.empty(n, dtype=np.uint64)
    gaps[0] = v[0] - np.uint64(base)
    np.subtract(v[1:], v[:-1], out=gaps[1:])
    mean = (int(v[-1]) - base) // n
    k = min(63, max(0, (mean * 693 // 1000).bit_length() - 1))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1)
    unary = np.zeros(int(ends[-1]), dtype=np.uint8)
    unary[ends - 1] = 1
    out = [_HEAD.pack(k, n, base), struct.pack("<I", len(unary)), np.packbits(unary).tobytes()]
    if k:
        rest = gaps & np.uint64((1 << k) - 1)
        bits = np.unpackbits(rest.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - k :]
        out.append(np.packbits(bits.reshape(-1)).tobytes())
    return b"".join(out)


def decode(blob: bytes) -> np.ndarray:
    k, n, base = _HEAD.unpack_from(blob)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    at = _HEAD.size
    (length,) = struct.unpack_from("<I", blob, at)
    at += 4
    size = (length + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=length))
    at += size
    q = np.diff(ends, prepend=-1) - 1
    gaps = q.astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, -1, at), count=n * k).reshape(n, k)
        full = np.zeros((n, 64), dtype=np.uint8)
        full[:, 64 - k :] = bits
        gaps |= np.packbits(full, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(base)


def bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(np.asarray(flags, dtype=np.uint8)).tobytes()


def unbitmap(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
