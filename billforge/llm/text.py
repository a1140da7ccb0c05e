"""Vectorised word hashing over Arrow text columns (used inside Spark tasks).

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; A-Z are lower-cased.
A word hash is a position-weighted sum of random byte values modulo 2**64, a
shingle hash mixes the hashes of its words, so equal words or shingles always
have equal hashes and different ones collide with probability about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
NOT_LETTERS = np.ones(256, bool)  # for word_bounds: words of letters only, bytes from 0x80 counting as letters
NOT_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20240501).integers(1, 2**63, 256).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 20, n)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.full(size, b, U64)) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a text column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, rows: int = 500):
    """The batches in parts of at most ``rows`` rows, so that copies of a part stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def blocks(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges [i, j) of documents of at most ``most`` bytes together, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of its document."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    sep = separators[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, sep[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, sep[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    word = ~sep
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the lower-cased bytes' values, for span_hashes."""
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUE[_LOWER[data]] * _power_tables(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def span_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from start to end for each pair."""
    return mix((total[ends] - total[starts]) * _power_tables(len(total))[1][starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(sums(data), starts, ends)


def chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, k, U64)
    for j in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out)


def shingles(column: pa.Array, k: int = 5):
    """Yield for each document its k-word shingle hashes in text order.

    With fewer than k words the whole sequence is one shingle; without words none.
    """
    data, offsets = text_buffer(column)
    for i, j in blocks(offsets):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, doc = word_bounds(part, own)
        words = word_hashes(part, starts, ends)
        grams = chain(words, k)
        first = np.searchsorted(doc, np.arange(j - i + 1))
        for d in range(j - i):
            a, b = first[d], first[d + 1]
            yield grams[a : b - k + 1] if b - a >= k else chain(words[a:b], b - a)[: int(b > a)]
