"""Words, shingles and packed hash columns of a batch of texts, as numpy arrays.

Words are maximal runs of bytes other than ASCII white space, with A-Z lower-cased.
A word is known by a 64-bit hash of its bytes, a shingle by a hash of its words' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the offsets of its rows; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch: ``start`` and ``end`` bytes, ``hash``, and ``first`` (each row's place of its first word, one more at the end)."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        inside = ~_SPACE[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = _hashed(_LOWER[data], self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    out = mixed(size.astype(U64) + U64(0x9E3779B97F4A7C15))
    if not len(size):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(np.frombuffer(padded.tobytes(), U64, 1), (len(data) + 1,), (1,))
    left = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(left):
        rest = np.minimum(size[left] - at, 8)
        lane = lanes[start[left] + at] & (U64(0xFFFFFFFFFFFFFFFF) >> ((8 - rest) * 8).astype(U64))
        out[left] = mixed(out[left] ^ lane)
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words; fewer words are one run, no words none."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    out = np.full(n, U64(min(width, len(words))))
    for k in range(min(width, len(words))):
        out = mixed(out * U64(0x9E3779B97F4A7C15) + words[k : k + n])
    return out


def pack(values: np.ndarray, size: int = 8) -> bytes:
    """Values as byte planes of their low ``size`` bytes: sorted values then compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def unpack(data: bytes, size: int = 8) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").ravel().astype(U64, copy=False)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])


def tallied(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts (1 each, if none are given)."""
    if counts is None:
        keys = np.sort(keys)
        at = runs(keys)
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = runs(keys)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def dealt(buckets: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its members in order), for each bucket that has any."""
    order = np.argsort(buckets.astype(np.uint32), kind="stable")
    ends = np.cumsum(np.bincount(buckets, minlength=n))
    begin = 0
    for b, end in enumerate(ends.tolist()):
        if end > begin:
            yield b, order[begin:end]
        begin = end


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """A bucket by the high bits of a key, so that a bucket's keys lie close together."""
    return ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)
