"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

A text's features are its words and word pairs and the shapes of both (letters, capitals, digits and signs), hashed into
2**18 weights; each group's weight is the share of the text's tokens, so a score is a sparse dot product: the mean of the
weights of its tokens. Training takes about ``fit_rows`` labelled texts of each class by hash of the id, in hash order, in
one task; classes are weighed back to their true shares. Scoring reads every whole text.

Defined results: a null or empty text has the one feature "no words"; labels that are null, not 0 or 1, or without a
document are not learned from; conflicting labels of one id are each learned from; with no labels every score is 0.5;
repeated rows agree; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import textops as T
from weft.llm.common import fold

FIT_ROWS = 3000
BINS = 1 << 18
SCALE = 6.0
EPOCHS = 4

#: Byte classes of word shapes.
KIND = np.full(256, 5, np.uint8)
KIND[97:123] = 1
KIND[128:] = 1
KIND[65:91] = 2
KIND[48:58] = 3
KIND[list(b".,;:?'\"-")] = 4
for _i, _b in enumerate(b"!#*$%&|<>@"):
    KIND[_b] = 6 + _i


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of every text's tokens, four a word, in text order; and each text's first."""
    starts, ends, bounds = T.words(data, offsets)
    word = T.range_hash(data, starts, ends, lower=True)
    kind = KIND[data]
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = True
    at = np.flatnonzero(change & ~T.SPACE[data])
    first = np.searchsorted(at, starts)
    shape = T.range_hash(kind[at], first, np.searchsorted(at, ends)) ^ np.uint64(0x5A5A)
    text = T.owner(bounds)
    joined = np.zeros(len(word), bool)
    joined[1:] = text[1:] == text[:-1]
    before, shape_before = np.roll(word, 1), np.roll(shape, 1)
    before[~joined], shape_before[~joined] = 0, 0
    pair = np.where(before == word, np.uint64(77), T.mix(before * np.uint64(3) + word))
    tokens = np.stack([word, pair, shape, T.mix(shape_before * np.uint64(5) + shape)], axis=1) % np.uint64(BINS)
    empty = np.flatnonzero(np.diff(bounds) == 0)
    tokens = np.insert(tokens, bounds[empty], np.uint64(BINS - 1), axis=0) if len(empty) else tokens
    counts = np.diff(bounds)
    counts[empty] = 1
    return tokens.astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def logit(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """weights: of the bins, then the bias."""
    tokens, bounds = features(data, offsets)
    each = weights[tokens].sum(axis=1, dtype=np.float64)
    return weights[-1] + SCALE * np.add.reduceat(each, bounds[:-1]) / np.diff(bounds) if len(bounds) > 1 else np.empty(0)


def train(rows: list[tuple[np.ndarray, np.ndarray, int, float]], alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> np.ndarray:
    """rows: bins, values, label, weight. FTRL-proximal, EPOCHS times over the rows."""
    z, n = np.zeros(BINS + 1), np.zeros(BINS + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(EPOCHS):
        for at, x, label, weight in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = weight * (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None)).astype(np.float32)


def _examples(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    tokens, bounds = features(data, offsets)
    for i in range(len(offsets) - 1):
        at, times = np.unique(tokens[bounds[i] : bounds[i + 1]], return_counts=True)
        yield np.append(at, BINS), np.append(SCALE * times / (bounds[i + 1] - bounds[i]), 1.0)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, hold_out: tuple[int, int] = (4, 2)) -> np.ndarray | None:
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(fold("doc_id", hold_out[0]) != hold_out[1])
    there = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not there:
        return None
    spin = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.when(F.col("quality") == 0, min(1.0, fit_rows / there.get(0, 1))).otherwise(min(1.0, fit_rows / there.get(1, 1)))
    # the sample has at most about 2 * fit_rows short rows, so that its side of the join is small by construction
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marked.where(spin < share * 1_000_000)), "doc_id").dropDuplicates(["doc_id", "quality", "text"])
    weigh = {q: max(1.0, n / fit_rows) for q, n in there.items()}
    mean = sum(there.values()) / sum(n / weigh[q] for q, n in there.items())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            labelled = batch.column(1).to_pylist()
            for i, _, data, offsets in T.slices(T.text_column(batch)):
                for k, (at, x) in enumerate(_examples(data, offsets)):
                    rows.append((at.astype(np.int32), x.astype(np.float32), labelled[i + k], weigh[labelled[i + k]] / mean))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([train(rows).tobytes()], pa.binary())], names=["weights"])

    got = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", "quality"), "doc_id", "quality", "text").select("doc_id", "quality", "text").mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(got[0]["weights"], np.float32) if got else None


def quality_classifier(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, hold_out: tuple[int, int] = (4, 2), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    score = scorer(fit(docs, labels, fit_rows, hold_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score(T.text_column(batch)))], names=["doc_id", "held_out", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), (fold("doc_id", hold_out[0]) == hold_out[1]).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def scorer(weights: np.ndarray | None):
    """A function from a column of texts to their scores."""

    def score(texts: pa.Array) -> np.ndarray:
        if weights is None:
            return np.full(len(texts), 0.5)
        parts = [logit(weights, data, offsets) for _, _, data, offsets in T.slices(texts)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate([np.empty(0), *parts]), -35, 35)))

    return score


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows whose score reaches the threshold, with their columns, scored in the pass that reads them; all rows where there are no
    labels to learn from."""
    weights = fit(docs, labels)
    if weights is None:
        return docs
    score = scorer(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(T.text_column(batch)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
