"""Content hashes, alike in Spark expressions and in Python."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa

#: Odd numbers that mix a band's values into a key; fixed values.
MIX = (-7046029254386353131, -4417276706812531889)
#: Hashes that are signed at once: so many stay in a core's cache.
AT_ONCE = 16_384


def hash_of(text: str) -> str:
    """What ``pyspark.sql.functions.md5`` gives for the text."""
    return md5(text.encode()).hexdigest()


def signatures(grams: np.ndarray, starts: np.ndarray, hashes: int = 128) -> np.ndarray:
    """The MinHash signature of each set: the smallest of its hashes under each permutation, which are exclusive ors with fixed numbers. A row for
    each permutation; sets (none empty) lie one after another in grams, from starts on."""
    out = np.empty((hashes, len(starts)), np.int64)
    for k in range(hashes):
        mask = np.int64(int(hash_of(f"mask {k}")[:16], 16) - (1 << 63))
        np.minimum.reduceat(grams ^ mask, starts, out=out[k])
    return out


def band_keys(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of id and grams (hashes, never none): id and keys, one for each band, equal where all of the band's values are."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(1)
        ends = column.offsets.to_numpy() - column.offsets[0].as_py()
        grams = column.flatten().to_numpy()
        keys, first = np.empty((batch.num_rows, bands), np.int64), 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + AT_ONCE, "right")) - 1)
            signed = signatures(grams[ends[first] : ends[last]], ends[first:last] - ends[first], bands * rows)
            mixed = np.repeat(np.arange(bands, dtype=np.int64)[:, None], last - first, 1)
            for r in range(rows):
                mixed = (mixed ^ signed[r::rows]) * np.int64(MIX[0])
                mixed = (mixed ^ (mixed >> 29)) * np.int64(MIX[1])
                mixed ^= mixed >> 32
            keys[first:last] = mixed.T
            first = last
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["id", "keys"])
