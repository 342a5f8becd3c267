"""Language ID with bit-sliced Bloom filters over byte n-grams.

One slot of the filter holds a bit mask of languages; an n-gram's mask is the AND of its slots, so one look-up returns all
languages that hold the n-gram, which are all in whose texts it was seen. An n-gram of a text is a vote that the languages of its mask
share (one over the mask's popcount to each); each language's votes are corrected by its false-positive rate (its fill to
the power of the number of slots), and the largest decides.

Learned from about ``fit_rows`` texts of each language, taken by hash of the id; the filter has a fixed size. Defined
results: ``und`` with score 0 for a null text or one with no letter, and for every text when nothing was learned; ties go
to the language that comes first by code point; rows are predicted one by one, so repeated rows agree; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import textops as T
from weft.llm.common import fold

FIT_ROWS = 1024
SLOTS = 1 << 18
HASHES = 2
SIZES = (2, 3, 4)

FOLDED = np.full(256, 32, np.uint8)
FOLDED[65:91] = np.arange(97, 123)
FOLDED[97:123] = np.arange(97, 123)
FOLDED[128:] = np.arange(128, 256)


def _folded(texts: pa.Array) -> pa.Array:
    return pa.array([t.lower() if t and not t.isascii() else t for t in texts.to_pylist()], pa.large_string())


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, hashes of the byte n-grams within texts, without those of spaces alone, and each text's first."""
    letters = FOLDED[data].astype(np.uint32)
    for n in SIZES:
        count = len(letters) - n + 1
        if count <= 0:
            yield np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
            continue
        value = np.zeros(count, np.uint32)
        for j in range(n):
            value = (value << np.uint32(8)) | letters[j : j + count]
        good = (letters[:count] != 32) | (letters[n - 1 :] != 32)
        for j in range(1, n):  # no n-gram crosses into the next text
            cross = offsets[1:-1] - j
            good[cross[(cross >= 0) & (cross < count)]] = False
        at = np.flatnonzero(good)
        value = (value[at] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        value = (value ^ (value >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        yield value ^ (value >> np.uint32(16)), np.searchsorted(at, offsets)


def slots(h: np.ndarray, k: int) -> np.ndarray:
    return ((h * np.uint32((0x9E3779B1, 0x7FEB352D, 0x846CA68B)[k])) >> np.uint32(14)) & np.uint32(SLOTS - 1)


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = _folded(T.text_column(batch))
        for i, j, data, offsets in T.slices(texts):
            for h, first in grams(data, offsets):
                own = np.repeat(langs[i:j], np.diff(first))
                for lang in sorted(set(langs[i:j])):
                    g = np.unique(h[own == lang])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64))], names=["lang", "gram"])


class Filters:
    """masks: by slot, with a word of 64 languages each; rate: by language, false positives per look-up."""

    def __init__(self, langs: list[str], masks: np.ndarray) -> None:
        self.langs, self.masks = langs, masks
        fill = np.array([((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
        self.rate = np.minimum(fill**HASHES, 0.95)

    def look_up(self, h: np.ndarray, word: int) -> np.ndarray:
        out = self.masks[slots(h, 0), word]
        for k in range(1, HASHES):
            out = out & self.masks[slots(h, k), word]
        return out


def build(counted: DataFrame) -> Filters:
    """Filters from the n-grams of each language (of a sample of bounded size)."""
    rows = counted.select("lang", "gram").distinct().toPandas()
    langs = sorted(set(rows["lang"]))
    masks = np.zeros((SLOTS, max(1, -(-len(langs) // 64))), np.uint64)
    for i, lang in enumerate(langs):
        g = rows["gram"][rows["lang"] == lang].to_numpy().astype(np.uint32)
        for k in range(HASHES):
            masks[slots(g, k), i // 64] |= np.uint64(1 << i % 64)
    return Filters(langs, masks)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(filters: Filters, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    size = len(filters.langs)
    names, scores = [], np.zeros(len(texts))
    for i, j, data, offsets in T.slices(_folded(texts)):
        hits, total = np.zeros((j - i, size)), np.zeros(j - i)
        for h, first in grams(data, offsets):
            masks = [filters.look_up(h, w) for w in range(filters.masks.shape[1])]
            vote = 1 / np.maximum(sum(np.bitwise_count(m).astype(np.int32) for m in masks), 1)
            total += T.total_by(vote, first)
            for w, own in enumerate(masks):
                own = own.astype(np.uint8) if size <= 8 else own
                for b in range(min(64, size - 64 * w)):
                    hits[:, 64 * w + b] += T.total_by(np.where((own >> own.dtype.type(b)) & own.dtype.type(1), vote, 0.0), first)
        right = np.maximum(0, (hits - filters.rate * total[:, None]) / (1 - filters.rate)) if size else hits
        for r in range(j - i):
            if not size or not has_letter(texts[i + r].as_py()):
                names.append("und")
                continue
            best = int(np.argmax(right[r]))
            names.append(filters.langs[best])
            scores[i + r] = right[r, best] / max(right[r].sum(), 1e-12)
    return names, np.clip(scores, 0, 1)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, hold_out: tuple[int, int] = (4, 2)) -> Filters:
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(fold("doc_id", hold_out[0]) != hold_out[1]).where("text is not null and lang is not null")
    there = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang in sorted(there):
        share = F.when(F.col("lang") == lang, min(1.0, fit_rows / there[lang])).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    return build(sample.select("lang", "text").mapInArrow(_grams_of, "lang string, gram long"))


def language_id(docs: DataFrame, fit_rows: int = FIT_ROWS, hold_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    filters = fit(docs, fit_rows, hold_out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(filters, T.text_column(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), (fold("doc_id", hold_out[0]) == hold_out[1]).alias("held_out"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")
