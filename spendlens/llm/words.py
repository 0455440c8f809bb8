"""Words, shingles and their 64-bit hashes for whole Arrow columns of texts, in numpy.

A block of texts is hashed in a few passes over its bytes: every byte adds a random number times a power of an odd
constant, so the hash of any word or run of words is a difference of two prefix sums. Equal sequences always get equal
hashes; the chance that any two different ones among n meet is about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time; a longer text is a block of its own.
BLOCK = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RANDOM = np.random.default_rng(20240501).integers(0, 1 << 64, 256, dtype=np.uint64)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, BLOCK + 1), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _powers[int(base)] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: pa.Array | pa.ChunkedArray, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them); a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words between white space: hashes, first bytes, end bytes, and the first word of each row (one more at the end)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACES[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]  # a row's end ends a word, whatever the next row begins with
    first[cuts] = inside[cuts]
    cuts = cuts[cuts > 0]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    value = _RANDOM[_LOWER] if lower else _RANDOM
    sums = value[raw]
    sums *= powers(_ODD, len(raw) + 1)[: len(raw)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(sums, dtype=np.uint64)))
    hashes = mix((sums[ends] - sums[starts]) * powers(_ODD_INVERSE, len(raw) + 1)[starts])
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, rows not minded; shorter by k - 1."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(_ODD, len(hashes)), dtype=np.uint64)))
    return mix((sums[k:] - sums[:-k]) * powers(_ODD_INVERSE, len(hashes))[: len(hashes) - k + 1] + np.uint64(k))
