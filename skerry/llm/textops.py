"""Vectorised text kernels over Arrow string buffers (numpy, no per-word Python).

All functions take a byte buffer and document offsets as Arrow lays them out, so
batches are read without copying. Memory is a small multiple of the block that is
worked on; long documents are hashed in pieces cut between words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class RunHash:
    """64-bit hashes of byte runs: eight bytes at a time through a bijective mix, XXH3 beyond ``SPAN`` bytes.

    Every step is non-linear, so no family of strings collides by its structure.
    """

    SPAN = 64

    def __init__(self, seed: int):
        self.seed = seed
        self.mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)

    def runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[starts[i]:ends[i]]."""
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))
        left = ends - starts
        out = mix64(left.astype(U64) + U64(self.seed))
        long_ = np.flatnonzero(left > self.SPAN)
        at = np.flatnonzero(left <= self.SPAN) if len(long_) else np.arange(len(starts))
        pos, left = starts[at], left[at]
        while len(at):
            out[at] = mix64((out[at] ^ (eight[pos] & self.mask[np.minimum(left, 8)])) * U64(0x9E3779B97F4A7C15))
            more = left > 8
            at, pos, left = at[more], pos[more] + 8, left[more] - 8
        if len(long_):
            raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
            out[long_] = np.fromiter((digest(raw[a:b], self.seed) for a, b in zip(starts[long_].tolist(), ends[long_].tolist())), U64, len(long_))
        return out


HASH_A = RunHash(20240607)


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of an Arrow string or binary array; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def blocks(offsets: np.ndarray, limit: int = 4 << 20):
    """Ranges of whole documents of about ``limit`` bytes; a longer one stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of words of each document."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    inside = ~_WS[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside
    last[:-1] &= ~last[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each document are set in ``mask``."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(mask, offsets[full], dtype=np.int64)
    return out


def windows(hashes: np.ndarray, k: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every k consecutive word hashes (those that cross documents included)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    m = U64(seed | 1)
    for j in range(k):
        out *= m
        out += hashes[j : j + n]
    return mix64(out)


def spread(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in [s, s + width) for any of ``starts``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, n), -1)
    return np.cumsum(d[:-1]) > 0
