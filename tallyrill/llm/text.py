"""Columnar text primitives in numpy, shared by the training-data operators.

A batch of texts is one uint8 buffer and the offsets of its texts. Words, hashes and content anchors are computed
for all texts of a batch at once, so the cost is a few array passes a byte and no Python object is made for a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 19
LONG_WORD = 192


def _flags(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], dtype=bool)


#: Bytes of a word when words are parted by white space.
NOT_SPACE = _flags(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of a word when words are letters, digits and whatever isn't ASCII.
ALNUM = _flags(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the n + 1 offsets of its values; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text is a part of its own."""
    _, at = utf8(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def word_bounds(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and the n + 1 offsets of each text's words; no word crosses two texts."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    inside = is_word[raw]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, at, "left")


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    size = ends - starts
    h = mix(size.astype(U64) + U64(0x9E3779B97F4A7C15))
    active = np.flatnonzero(size <= LONG_WORD)
    k = 0
    while len(active):
        active = active[size[active] > k]
        h[active] = (h[active] ^ (raw[starts[active] + k].astype(U64) + U64(1))) * U64(0x9FB21C651E98DF25)
        h[active] ^= h[active] >> U64(32)
        k += 1
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


_BASE = 0xD1342543DE82EF95
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    p = _POWERS.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, 1 << 16), base, U64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        _POWERS[base] = p
    return p[:n]


class Spans:
    """Hashes of arbitrary runs of a sequence of 64-bit symbols, from one prefix sum."""

    def __init__(self, symbols: np.ndarray, seed: int = 0):
        s = mix(symbols ^ U64(seed)) if seed else symbols
        n = len(s)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(s * _powers(_BASE, n), out=self.sums[1:])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        length = (last - first).astype(U64)
        return mix((self.sums[last] - self.sums[first]) * self.inverse[first] + length * U64(0x9E3779B97F4A7C15))


def byte_grams(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position, k a power of two; the last k - 1 positions are missing."""
    h = mix(raw.astype(U64) + U64(1))
    step = 1
    while step < k:
        a, b = h[:-step], h[step:]
        h = (a ^ (b << U64(23)) ^ (b >> U64(41))) * U64(0x9FB21C651E98DF25)
        h ^= h >> U64(29)
        h += b * U64(0xC2B2AE3D27D4EB4F)
        step *= 2
    return mix(h)


def anchors(grams: np.ndarray, at: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content-chosen positions such that equal windows choose equal offsets.

    ``grams[i]`` is a hash of symbols i .. i+k-1; ``at`` are the offsets of the texts. Every window of ``window``
    symbols within one text has one anchor, the leftmost least gram in it. Returned are the distinct anchors and
    the first and last start of the windows that chose each.
    """
    n, w = int(at[-1]), window - k + 1
    if n < window:
        e = np.empty(0, np.int64)
        return e, e, e
    key = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    best, have = key, 1
    while have * 2 <= w:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < w:
        best = np.minimum(best[: len(best) - (w - have)], best[w - have :])
    ok = np.zeros(n + 1, np.int32)
    begin, end = at[:-1], at[1:] - window + 1
    keep = end > begin
    np.add.at(ok, begin[keep], 1)
    np.add.at(ok, end[keep], -1)
    p = np.flatnonzero(np.cumsum(ok)[: len(best)] > 0)
    if not len(p):
        e = np.empty(0, np.int64)
        return e, e, e
    a = (best[p] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return a[first], p[first], p[last]


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges first .. last - 1, and the index of each one's range."""
    size = last - first
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size), which


def covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the ranges first .. last - 1."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, last, -1)
    return np.cumsum(depth[:n]) > 0
