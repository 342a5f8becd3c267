"""Vectorised kernels over the UTF-8 bytes of many texts at once.

Texts come as an Arrow column and are worked through in slices of half a megabyte, so memory is bounded by the slice or by
the longest single text. Words are maximal runs of bytes other than space and \\t to \\r. Hashes are 64 bits wide: a
polynomial over random byte values modulo 2**64, then a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BYTE_VALUE_LOWER = BYTE_VALUE[LOWER]
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
LENGTH_SALT = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    if len(_powers.get(base, ())) < n:
        size = max(n, SLICE_BYTES + 1)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in turn, covering every row; a null text has no bytes."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of solid bytes that no text boundary crosses, and each text's first run."""
    edge = np.zeros(len(solid) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~SPACE[data], offsets)


def owner(bounds: np.ndarray) -> np.ndarray:
    """The text number of each item, from the first item of each text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash of each byte range; equal for equal bytes wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((BYTE_VALUE_LOWER if lower else BYTE_VALUE)[data] * powers(BASE, len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * LENGTH_SALT)


def window_hash(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k items within a text, and each window's first item."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j, m in enumerate(powers(0xC2B2AE3D27D4EB4F, k + 1)[1:]):
        out += h[j : j + n] * m
    text = owner(bounds)
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    return mix(out[at] + np.uint64(k)), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted set of hashed k-word shingles, A-Z lower-cased; with fewer words, the whole sequence as one."""
    starts, ends, bounds = words(data, offsets)
    h = range_hash(data, starts, ends, lower=True)
    grams, at = window_hash(h, bounds, k)
    first = np.searchsorted(at, bounds)
    for i in range(len(offsets) - 1):
        n = bounds[i + 1] - bounds[i]
        if n >= k:
            yield np.unique(grams[first[i] : first[i + 1]])
        elif n:
            yield window_hash(h[bounds[i] : bounds[i + 1]], np.array([0, n]), int(n))[0]
        else:
            yield np.empty(0, np.uint64)


def total_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each text's items."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
