"""Sets of word shingles as sorted arrays of 64-bit hashes, computed for many texts at once.

Sets are hashed under a secret that a job draws anew (``secret``). Words and shingles run through multilinear forms
(sums of 32-bit pieces times random 64-bit numbers, of which the upper halves count), for which it is proven that two
different inputs, chosen without the secret, agree with a chance of 2 ** -32 for each half, whatever they are. So no
text can be written that shares shingles with another by its hashes alone.
"""

from __future__ import annotations

import functools
import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .langid import spans

#: Bytes of text worked on at a time (a longer text is worked on alone).
SLICE = 1 << 21
#: Longest word, in bytes, that is hashed along with all others.
LONGEST = 256
_BLANK = np.zeros(256, np.bool_)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_EIGHT, _32, _LOW, _ALL = np.uint64(8), np.uint64(32), np.uint64(2**32 - 1), np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well spread bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight of the size bytes of data from each place on, as an integer; data ends in eight bytes of padding."""
    view = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), 0, (1,))
    return view[at] & (_ALL >> (_EIGHT * (_EIGHT - np.minimum(size, 8).astype(np.uint64))))


def hashes(data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings of one byte or more at lo; data ends in eight bytes of padding.

    For tables that compare the strings themselves, or may mistake one for another: there is no secret in them.
    """
    size = size.astype(np.int64)
    first = eights(data, lo, size)
    start = mixed(size.astype(np.uint64) * _A)
    out = mixed(first ^ start)
    rest = np.flatnonzero(size > 8)
    if rest.size:
        a, b, at, left = out[rest], mixed(first * _B + start), lo[rest] + 8, size[rest] - 8
        b = b[rest]
        while True:
            piece = eights(data, at, left)
            a, b = mixed((a ^ piece) * _A), mixed((b + piece) * _B)
            on = left > 8
            stop = ~on
            out[rest[stop]] = mixed(a[stop] ^ ((b[stop] << _32) | (b[stop] >> _32)))
            if not on.any():
                break
            rest, a, b, at, left = rest[on], a[on], b[on], at[on] + 8, left[on] - 8
    return out


def secret() -> bytes:
    """A new secret for a job, drawn in the driver and sent to tasks with their code."""
    return secrets.token_bytes(32)


@functools.lru_cache(8)
def factors(key: bytes, use: str, n: int) -> np.ndarray:
    """Two rows of n numbers that only the key tells."""
    return np.frombuffer(hashlib.shake_256(key + use.encode()).digest(16 * n), "<u8").reshape(2, n)


def halves(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one & ~_LOW) | (two >> _32)


def word_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: bytes) -> np.ndarray:
    """Hashes of the words of data from lo to hi, which is lower-cased already."""
    f = factors(key, "words", 2 + LONGEST // 4)
    size = (hi - lo).astype(np.int64)
    sums = [f[i, 0] + f[i, 1] * size.astype(np.uint64) for i in range(2)]
    padded, rest, at, left, k = np.concatenate((data, np.zeros(8, np.uint8))), np.arange(len(lo)), lo, np.minimum(size, LONGEST), 2
    while rest.size:
        piece = eights(padded, at, left)
        first, second = piece & _LOW, piece >> _32
        for i in range(2):
            sums[i][rest] += f[i, k] * first + f[i, k + 1] * second
        on = left > 8
        rest, at, left, k = rest[on], at[on] + 8, left[on] - 8, k + 2
    out = halves(*sums)
    for i in np.flatnonzero(size > LONGEST):
        out[i] = int.from_bytes(hashlib.blake2b(data[lo[i] : hi[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return out


def chained(words: list[np.ndarray], k: int, key: bytes) -> np.ndarray:
    """Hashes of sequences of up to k words, given as an array for each place; a shorter sequence is told by its length."""
    f = factors(key, f"shingles of {k}", 2 + 2 * k)
    sums = [np.full(len(words[0]), (int(f[i, 0]) + int(f[i, 1]) * (len(words) % k)) % 2**64, np.uint64) for i in range(2)]
    for s, w in enumerate(words):
        for i in range(2):
            sums[i] += f[i, 2 + 2 * s] * (w & _LOW) + f[i, 3 + 2 * s] * (w >> _32)
    return halves(*sums)


def words(data: np.ndarray, ends: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another, and each text's first word (and the number of all)."""
    first = int(ends[0])
    data, ends = data[first : int(ends[-1])], ends - first
    full = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, np.bool_)
    edge[ends] = True
    before = np.concatenate(([False], full[:-1])) & ~edge[:-1] if len(data) else full
    after = np.concatenate((full[1:], [False])) & ~edge[1:] if len(data) else full
    lo, hi = np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1
    return word_hashes(_LOWER[data], lo, hi, key), np.searchsorted(lo, ends)


def sets(column: pa.Array, k: int, key: bytes) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles, sorted; a text with fewer words is one shingle, one without has none."""
    data, ends = spans(column)
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, "right")) - 1)
        w, at = words(data, ends[i : j + 1], key)
        m = len(w) - k + 1
        chain = chained([w[s : s + m] for s in range(k)], k, key) if m > 0 else w[:0]
        for d in range(j - i):
            a, b = int(at[d]), int(at[d + 1])
            if b - a >= k:
                yield np.unique(chain[a : b - k + 1])
            elif b > a:
                yield chained([w[x : x + 1] for x in range(a, b)], k, key)
            else:
                yield np.zeros(0, np.uint64)
        i = j
