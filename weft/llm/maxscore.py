"""Exact top-k search by integer inner product, with MaxScore.

A vector's components are the terms of a document. Within a shard, each term's contribution to a query is shifted to be
non-negative, so every term has a score bound. A query's terms are split by these bounds: the smallest ones that together
cannot reach the k-th best score so far are non-essential. Essential postings are traversed for the whole shard; the others
are probed, largest bound first, only for rows that can still compete. The shards' lists are merged.

Queries go in blocks to every shard (an equi-join on the shard's number), so a task holds one block and one shard, both of
bounded size. Defined results: vectors that are null or hold null or non-finite components take no part; a missing component
counts 0; rows equal in id and vector count once; rows of the query's own id are no candidates; an empty table gives no row;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import cut

#: Rows of a shard and of a query block: an eighth and a third of all, within these bounds.
SHARD_ROWS, BLOCK_ROWS = (4096, 131072), (512, 8192)
PROBE = 8


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search(query: np.ndarray, own: int, ids: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best rows of a shard. columns: one row per term, exact in its float type."""
    floor = np.minimum(query * low, query * high)
    bound = np.maximum(query * low, query * high) - floor
    order = np.argsort(-bound, kind="stable")
    open_bound = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what terms from here on can add
    base = floor.sum()
    mine = ids == own
    seed = np.arange(min(len(ids), 8 * k))
    first = query @ columns[:, seed]
    first = first[~mine[seed]]
    least = np.partition(first, len(first) - k)[len(first) - k] if len(first) >= k else -np.inf
    essential = int(np.searchsorted(-(base + open_bound), -least, "right"))  # beyond it, terms alone stay below
    essential = min(max(essential, 1), len(order))
    part = order[:essential]
    score = query[part] @ columns[part] + floor[order[essential:]].sum()
    rows = np.flatnonzero((score + open_bound[essential] >= least) & ~mine)
    score = score[rows]
    while essential < len(order):
        if len(rows) > 4 * k:  # exact scores of the best so far raise what others must reach
            some = np.argpartition(score, len(score) - k)[len(score) - k :]
            least = max(least, (query @ columns[:, rows[some]]).min())
            alive = score + open_bound[essential] >= least
            rows, score = rows[alive], score[alive]
        part = order[essential : essential + PROBE]
        score = score + query[part] @ columns[np.ix_(part, rows)] - floor[part].sum()
        essential += len(part)
    best = top_of(score, ids[rows], k)
    return rows[best], score[best]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition as one."""
    ids, vectors = [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        vectors += [np.asarray(v, np.int64) for v in batch.column(1).to_pylist()]
    if ids:
        out = np.zeros((len(ids), max(map(len, vectors))), np.int64)
        for row, v in zip(out, vectors, strict=True):
            row[: len(v)] = v
        kind = np.int16 if out.size and np.abs(out).max() < 1 << 15 else np.int64
        yield pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([out.astype(kind).tobytes()], pa.binary()), pa.array([np.dtype(kind).str])], names=["ids", "vectors", "kind"])


def _unpack(ids: bytes, vectors: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(vectors, np.dtype(kind)).reshape(len(own), -1)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row whose id is divisible by ``every``."""
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null").where(fine)
    integers = cut(whole.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v")).dropDuplicates(["vec_id", "v"]))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    there = integers.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()

    def parts(n: int, share: int, bounds: tuple[int, int]) -> int:
        return max(1, -(-n // min(max(n // share, bounds[0]), bounds[1])))

    n_shards, n_blocks = parts(there["n"], 8, SHARD_ROWS), parts(there["q"], 3, BLOCK_ROWS)
    packed = "ids binary, vectors binary, kind string"
    shards = integers.repartition(n_shards).mapInArrow(_pack, packed)
    shards = cut(shards.withColumn("shard", F.spark_partition_id()))
    blocks = cut(integers.where(is_query).repartition(n_blocks).mapInArrow(_pack, packed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                queries, q = _unpack(r["q_ids"], r["q_vectors"], r["q_kind"])
                ids, x = _unpack(r["ids"], r["vectors"], r["kind"])
                width = max(q.shape[1], x.shape[1])
                q, x = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (q, x))
                most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(width, 1) * 2
                kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
                columns = np.ascontiguousarray(x.T.astype(kind))
                if not width:
                    columns, q = np.zeros((1, len(ids)), kind), np.zeros((len(queries), 1))
                low, high = columns.min(axis=1), columns.max(axis=1)
                found = [search(v.astype(kind), own, ids, columns, low, high, k) for own, v in zip(queries, q, strict=True)]
                counts = [len(rows) for rows, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, counts)), pa.array(ids[np.concatenate([rows for rows, _ in found])]), pa.array(np.concatenate([s for _, s in found]).astype(np.int64))], names=["query_id", "vec_id", "score"])

    asked = blocks.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("kind").alias("q_kind"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    pairs = asked.join(shards, "shard").repartition(max(1, n_shards * n_blocks))
    lists = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
