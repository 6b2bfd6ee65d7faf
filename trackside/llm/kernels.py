"""Vectorised word kernels (numpy) used inside Spark tasks.

All functions work on one *chunk*: a few MB of text whose words are separated
by single separator bytes. A word is hashed from its bytes in eight-byte lanes,
so the cost is per word and not per byte.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_K1, _K2, _K3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=U64)
END_WORD = U64(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that every bit of a key can be used."""
    x = x ^ (x >> U64(30))
    x = x * _K2
    x ^= x >> U64(27)
    x *= _K3
    x ^= x >> U64(31)
    return x


def word_spans(raw: bytes, seps: bytes = b" \n") -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the non-empty runs between separator bytes."""
    table = np.zeros(256, dtype=bool)
    table[list(seps)] = True
    sep = table[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sep, [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word, from all its bytes."""
    lens = ends - starts
    h = lens.astype(U64) * _K1
    if not len(lens):
        return h
    padded = np.frombuffer(raw + b"\0" * 16, dtype=np.uint8)
    lanes = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    rows, off, longest = None, 0, int(lens.max())
    while off < longest:
        if rows is None:
            v = lanes[starts] & _MASKS[np.minimum(lens, 8)]
            h = mix((h ^ v) * _K1)
        else:
            v = lanes[starts[rows] + off] & _MASKS[np.minimum(lens[rows] - off, 8)]
            h[rows] = mix((h[rows] ^ v) * _K1)
        off += 8
        rows = np.flatnonzero(lens > off) if rows is None else rows[lens[rows] > off]
    return h


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (length ``len(h) - n + 1``)."""
    if len(h) < n:
        return np.zeros(0, dtype=U64)
    g = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        g *= _K2
        g += h[j: len(h) - n + 1 + j]
    return mix(g)


def sliding_min(k: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` consecutive values (doubling, log2(width) passes)."""
    if len(k) < width:
        return k[:0]
    a, have = k, 1
    while have * 2 <= width:
        a = np.minimum(a[: len(a) - have], a[have:])
        have *= 2
    rest = width - have
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def group_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values[offsets[i]:offsets[i + 1]]``; empty groups give 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def pack_ints(*arrays: np.ndarray) -> bytes:
    """Integer arrays as byte planes, so that a general compressor drops the empty ones."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(np.array([a.dtype.itemsize, len(a)], dtype="<i8").tobytes())
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes())
    return b"".join(parts)


def unpack_ints(raw: bytes, *dtypes) -> list[np.ndarray]:
    out, at = [], 0
    for d in dtypes:
        size, n = np.frombuffer(raw, dtype="<i8", count=2, offset=at).tolist()
        at += 16
        planes = np.frombuffer(raw, dtype=np.uint8, count=size * n, offset=at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(d).reshape(n))
        at += size * n
    return out
