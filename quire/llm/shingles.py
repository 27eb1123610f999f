"""Sets of hashed word n-grams, straight from Arrow's UTF-8 buffers.

A word's hash is a sum of random numbers for its bytes times powers of an odd base, modulo 2 ** 64: a difference of
two running sums over the whole buffer, so that no word becomes an object of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_A, _M1, _M2 = np.uint64(0xD1342543DE82EF95), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = np.array([xxhash.xxh3_64_intdigest(bytes([b]).lower()) for b in range(256)], np.uint64)  # A-Z as a-z
_powers: list[np.ndarray] = []


def _mix(g: np.ndarray) -> np.ndarray:
    g = (g ^ g >> np.uint64(30)) * _M1
    g = (g ^ g >> np.uint64(27)) * _M2
    return g ^ g >> np.uint64(31)


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``size``."""
    if not _powers or len(_powers[0]) < size:
        size = max(size, 1 << 16)
        base = np.full(size, _BASE, np.uint64)
        inverse = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _powers[:] = np.cumprod(base), np.cumprod(inverse)
    return _powers[0], _powers[1]


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the first word of each text and one past the last). bounds: of the texts."""
    size = len(data)
    inside = ~_SPACE[data]
    cut = np.zeros(size + 1, bool)
    cut[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:size]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:size]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[:size], out=total[1:])
    h = _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, bounds)


def sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-word shingles; of fewer words, of all as one; none without words.

    Words are runs of anything but ASCII white space, A-Z in lower case. Null is as empty.
    """
    a = texts.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    if not len(a):
        return
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
            h, words = _words(data[at[i] : at[j]], at[i : j + 1] - at[i])
            g = h[: max(0, len(h) - n + 1)] + np.uint64(n)
            for k in range(1, n):
                g = g * _A + h[k : len(h) - n + 1 + k]
            g = _mix(g)
            for p, q in zip(words[:-1].tolist(), words[1:].tolist()):
                if q - p >= n:
                    yield np.unique(g[p : q - n + 1])
                elif q > p:
                    yield np.array([xxhash.xxh3_64_intdigest(h[p:q].tobytes())], np.uint64)
                else:
                    yield np.empty(0, np.uint64)
            i = j


def set_id(s: np.ndarray) -> int | None:
    """A signed 64-bit hash of a set, None for the empty one."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s) & 0xFFFFFFFF)))) if len(s) else None
