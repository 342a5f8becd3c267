"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut, release


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges (u, v), as stars: each node that is not the smallest of its tree, with the smallest."""
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1)[u != v], axis=0)
    nodes, ends = np.unique(pairs, return_inverse=True)
    ends = ends.reshape(-1, 2)
    up = list(range(len(nodes)))
    for a, b in ends.tolist():
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        up[max(a, b)] = min(a, b)
    root = np.array(up, np.int64)
    while len(root) and (root[root] != root).any():
        root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[other]], nodes[other]


def components(links: DataFrame, most: int) -> DataFrame:
    """node, label of every node of the links (u, v) but those to itself: label is the smallest node that links reach. most:
    how many nodes there are about, at most; only the number of files depends on it.

    Each round hooks every node to its smallest neighbour, jumps once, and goes on with the links between what is left: half
    of the nodes at most, so all rounds together read and write a few times the links."""
    edges = cut(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), most)
    rounds: list[DataFrame] = []
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("up")), most)
        rounds.append(cut(hooked.join(hooked.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up")), most))
        of = {s: rounds[-1].select(F.col("node").alias(s), F.col("up").alias(f"up_{s}")) for s in "uv"}
        ends = edges.join(of["u"], "u").join(of["v"], "v").where("up_u <> up_v")
        left = cut(ends.select(F.least("up_u", "up_v").alias("u"), F.greatest("up_u", "up_v").alias("v")).distinct(), most)
        release(edges, hooked)
        edges = left
        if edges.isEmpty():
            break
        most = most // 2
    labels = rounds[-1].withColumnRenamed("up", "label")
    for earlier in reversed(rounds[:-1]):
        labels = earlier.join(labels.select(F.col("node").alias("up"), "label"), "up", "left").select("node", F.coalesce("label", "up").alias("label"))
    labels = cut(labels, most)
    release(edges, *rounds)
    return labels
