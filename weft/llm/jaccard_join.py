"""N-gram Jaccard join by partitioning the universe of shingles, exact.

Let two sets of n and n' shingles have Jaccard similarity t or more. Then they differ in at most
H = (n + n')(1 - t)/(1 + t) shingles. Hash the universe into m segments: at most H of them differ, so if a set has more than
H non-empty segments, one non-empty segment is identical in both. m depends on the size band (powers of two) of the smaller
set; a set is indexed in its own band and, if the band below can hold partners, in that one.

Cost-based allocation: identical segments form a set of their own, of which any two partners share all but H, so under one
global order only the first H + 1 need be indexed. The order is by what a segment costs: a sketch of fixed size counts all
shingles of all sets, segments that hold a shingle rare in the corpus come first, and of these the ones of many shingles. Long
lists, which come from passages many documents share, are so built only for sets that have little else. A set with too few
non-empty segments indexes them all and their one-deletion neighbourhoods (a segment that differs in one shingle then still
meets, so it counts for two); if even these are too few, all its shingles too.

Sets with a key in common may be similar. A task pre-aggregates what it has seen: it sends each key once, and what its own sets
share as a spanning forest, so that a key of any number of sets is a row for each task at most. The components of these
edges are the groups in which all similar pairs lie. A group's sets are dealt into blocks, and each two blocks are compared in
a task of their own, which gives back a spanning forest and no pairs. This is done twice: first with sizes and parity bitmaps (the
bits in which two sets differ are at most the shingles in which they differ), which leaves smaller groups of sets that may be
similar; then with these groups' sets, where pairs that bitmaps allow are verified exactly unless both are linked already. So
rows and shuffled bytes grow with the sets and, for groups beyond the size of a few blocks, with a group's blocks. No pair of
different components is left out.

Equal sets are one node throughout, so groups of copies cost one. Defined results: sets of fewer than k words are the whole
sequence; a text without words, or null, has an empty set and is linked with nothing; repeated rows and ids are rows of the
result each; a row with a null id links as any other, and a component's id is its smallest that is not null, or null if there is
none; other columns are not read. ``one_of_each`` keeps one row of each component, of its smallest id (of a component of null
ids alone: of its smallest node), and all rows without words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weft.llm import textops as T
from weft.llm.common import cut, held, release, shuffle_partitions
from weft.llm.components import components, forest

#: Similarity from which documents link, as a fraction of whole numbers.
SIMILAR = (75, 100)
#: Segments for each shingle of the largest set of a band.
SEGMENTS = 0.40
#: Keys that a task packs at once, and nodes that it remembers to have packed.
FLUSH, REMEMBERED = 500_000, 200_000
#: Slots of the sketch of shingle counts, and ranges in which it is summed.
SLOT_BITS, RANGES = 22, 64
#: Bits of the filter for the nodes that have a key in common with another, at most.
FILTER_BITS = 27
#: Bytes of keys that a part of the index holds about.
PART_BYTES = 16 << 20
#: What a block holds, of bitmaps in nodes and of sets in shingles: at least, unless these make more blocks than the third number,
#: and at most.
BITMAP_BLOCKS, SET_BLOCKS = (128, 1 << 15, 32), (1 << 16, 1 << 21, 8)
U = np.uint64


def node_of(shingles: np.ndarray) -> int:
    """A hash of the set, signed."""
    return int(T.mix(T.mix(shingles ^ U(0xA5A5A5A5)).sum(keepdims=True, dtype=np.uint64) + U(len(shingles))).view(np.int64)[0])


def bitmap(shingles: np.ndarray, each: int = 4) -> np.ndarray:
    """Parity of the set's hashes by bit, over a power of two of bits above ``each`` times the set's size, as 64-bit words."""
    bits = max(64, 1 << (each * len(shingles)).bit_length())
    odd = (np.bincount((shingles % U(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap over fewer bits."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_differ(n: int | np.ndarray, other: int | np.ndarray, similar: tuple[int, int] = SIMILAR) -> int | np.ndarray:
    return (n + other) * (similar[1] - similar[0]) // (similar[1] + similar[0])


def slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U(64 - SLOT_BITS)).astype(np.int64)


def keys(shingles: np.ndarray, similar: tuple[int, int] = SIMILAR, levels: np.ndarray | None = None) -> np.ndarray:
    """What the set is indexed under. levels: by slot of the sketch, how frequent its shingles are; any order keeps the join
    exact as long as it is the same for all sets."""
    n = len(shingles)
    num, den = similar
    value = T.mix(shingles ^ U(0x5DEECE66D))
    level = np.zeros(n, np.uint8) if levels is None else levels[slot(shingles)]
    band = n.bit_length() - 1
    roles = [(band, n * (den - num) // num)]
    top = (1 << band) - 1  # largest set of the band below
    if band and top * den >= n * num:
        roles.append((band - 1, may_differ(n, top, similar)))
    out = []
    for role, differ in roles:
        m = int(SEGMENTS * ((1 << (role + 1)) - 1)) + 1
        segment = ((shingles >> U(13)) % U(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        own, first, count = np.unique(segment[order], return_index=True, return_counts=True)
        total = np.add.reduceat(value[order], first)
        salt = own.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(role + 1)
        exact = T.mix(T.mix(total + count.astype(np.uint64)) ^ salt)
        if len(own) > differ:
            out.append(exact[np.lexsort((exact, -count, np.minimum.reduceat(level[order], first)))[: differ + 1]])
            continue
        out.append(exact)
        each = np.repeat(np.arange(len(own)), count)
        left = count[each] - 1
        deleted = T.mix(T.mix(total[each] - value[order] + left.astype(np.uint64)) ^ salt[each])
        out.append(deleted[left > 0])
        if np.minimum(count, 2).sum() <= differ:
            out.append(T.mix(value + U(role + 101)))
    return np.unique(np.concatenate(out))


FACTS = ["doc_id", "n", "node", "bits", "k", "at", "times"]


def facts(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n (shingles), node, bits (bitmap) of every document (k is null); and for each task, by range k of the sketch's slots, those
    that its sets often have, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SLOT_BITS, np.uint32)
        seen: set[int] = set()
        for batch in batches:
            for i, j, data, offsets in T.slices(T.text_column(batch)):
                n, nodes, bits = [], [], []
                for s in T.shingle_sets(data, offsets, words):
                    n.append(len(s))
                    nodes.append(node_of(s) if len(s) else None)
                    bits.append(bitmap(s, 2).tobytes() if len(s) else None)
                    if len(s) and nodes[-1] not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(nodes[-1])
                        np.add.at(sketch, slot(s), np.uint32(1))
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), none, *[pa.nulls(j - i, pa.binary())] * 2], names=FACTS)
        mean = float(sketch.mean())
        at = np.flatnonzero(sketch >= 3 + int(2 * mean + 3 * mean**0.5))
        edges = np.searchsorted(at, np.arange(RANGES + 1) << (SLOT_BITS - RANGES.bit_length() + 1))
        for k in np.flatnonzero(np.diff(edges)):
            some = at[edges[k] : edges[k + 1]]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.binary()), pa.array([int(k)]), *(pa.array([x.astype(np.uint32).tobytes()], pa.binary()) for x in (some, sketch[some]))], names=FACTS)

    return docs.mapInArrow(run, "doc_id long, n long, node long, bits binary, k long, at binary, times binary")


def frequency_levels(found: DataFrame) -> bytes:
    """By slot of the sketch, the logarithm of the number of sets that have it where that is far above the mean, else 0; compressed."""
    width = (1 << SLOT_BITS) // RANGES

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, start = np.zeros(width), key[0].as_py() * width
        for batch in rows:
            for at, times in zip(batch.column(1), batch.column(2), strict=True):
                total[np.frombuffer(at.as_buffer(), np.uint32).astype(np.int64) - start] += np.frombuffer(times.as_buffer(), np.uint32)
        level = np.where(total >= 4 + 2 * total.mean(), 1 + np.log2(np.maximum(total, 1)), 0).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], names=["k", "level"])

    out = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in found.where("k is not null").select("k", "at", "times").groupBy("k").applyInArrow(add, "k long, level binary").collect():
        out[r["k"] * width : (r["k"] + 1) * width] = np.frombuffer(zlib.decompress(r["level"]), np.uint8)
    return zlib.compress(out.tobytes(), 1)


@lru_cache(maxsize=2)
def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def index(docs: DataFrame, parts: int, words: int, similar: tuple[int, int], levels: bytes) -> DataFrame:
    """part, and packed: nodes, then for each key the place of its node, and the keys' upper halves (the part follows from the
    lower one). A row without keys has edges between nodes that share one within the task: nodes and place are their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = _unpacked(levels)
        nodes: list[int] = []
        found: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if not nodes:
                return
            every = np.concatenate(found)
            place = np.repeat(np.arange(len(found), dtype=np.int32), list(map(len, found)))
            order = np.argsort(every, kind="stable")
            every, place = every[order], place[order]
            again = np.flatnonzero(every[1:] == every[:-1]) + 1
            ids = np.array(nodes, np.int64)
            u, v = forest(ids[place[again - 1]], ids[place[again]])
            if len(u):
                yield _packed(int(ids[0] % parts), u.tobytes(), v.tobytes(), None)
            once = np.ones(len(every), bool)
            once[again] = False
            every, place = every[once], place[once]
            part = ((every & U(0xFFFFFFFF)) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)):
                at = order[edges[p] : edges[p + 1]]
                used, local = np.unique(place[at], return_inverse=True)
                yield _packed(int(p), ids[used].tobytes(), local.astype(np.int32).tobytes(), (every[at] >> U(32)).astype(np.uint32).tobytes())
            nodes.clear()
            found.clear()
            size = 0

        for batch in batches:
            for _, _, data, offsets in T.slices(T.text_column(batch)):
                for s in T.shingle_sets(data, offsets, words):
                    if len(s) and (node := node_of(s)) not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(node)
                        nodes.append(node)
                        found.append(keys(s, similar, level))
                        size += len(found[-1])
                if size >= FLUSH:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "part long, nodes binary, place binary, keys binary")


def _packed(part: int, nodes: bytes, place: bytes, keys_: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), *(pa.array([x], pa.binary()) for x in (nodes, place, keys_))], names=["part", "nodes", "place", "keys"])


def _shared(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the nodes of a part that are joined by a key."""
    node, hashed, ends = [], [], []
    for batch in rows:
        for n, at, k in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            n = np.frombuffer(n.as_buffer(), np.int64)
            if k.is_valid:
                node.append(n[np.frombuffer(at.as_buffer(), np.int32)])
                hashed.append(np.frombuffer(k.as_buffer(), np.uint32))
            else:
                ends.append((n, np.frombuffer(at.as_buffer(), np.int64)))
    if node:
        n, k = np.concatenate(node), np.concatenate(hashed)
        order = np.argsort(k, kind="stable")
        n, k = n[order], k[order]
        again = np.flatnonzero(k[1:] == k[:-1]) + 1
        ends.append((n[again - 1], n[again]))
    u, v = forest(*(np.concatenate(x) for x in zip(*ends, strict=True)))
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def node_filter(nodes: DataFrame) -> bytes:
    """A bit for each value that a node's hash may have, set if there is such a node; compressed, of a bounded size."""
    bits = 1 << min(FILTER_BITS, max(16, (8 * nodes.count()).bit_length()))
    width = bits // RANGES

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, start = np.zeros(width, np.uint8), key[0].as_py() * width
        for batch in rows:
            there[batch.column(1).to_numpy() - start] = 1
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(there).tobytes()], pa.binary())], names=["k", "bits"])

    at = F.pmod("node", F.lit(bits))
    got = nodes.select(F.floor(at / width).cast("long").alias("k"), at.cast("long").alias("at")).distinct().groupBy("k").applyInArrow(add, "k long, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in got:
        out[r["k"] * width // 8 : (r["k"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
    return zlib.compress(out.tobytes(), 1)


def sets_of(docs: DataFrame, words: int, there: bytes) -> DataFrame:
    """node, set: the shingles of texts whose node may be in the filter, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _unpacked(there)
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in T.slices(T.text_column(batch)):
                nodes, sets = [], []
                for s in T.shingle_sets(data, offsets, words):
                    if len(s) and (node := node_of(s)) not in seen:
                        at = node % (8 * len(bits))
                        if bits[at >> 3] & (128 >> (at & 7)):
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen.add(node)
                            nodes.append(node)
                            sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])

    return docs.mapInArrow(run, "node long, set binary")


def similar_sets(a: np.ndarray, b: np.ndarray, similar: tuple[int, int] = SIMILAR) -> bool:
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return similar[1] * both >= similar[0] * (len(a) + len(b) - both)


class _Block:
    """Nodes of a block pair by size: which others each may be similar to."""

    def __init__(self, nodes: list[int], n: list[int], bits: list[np.ndarray], side: list[int], similar: tuple[int, int]) -> None:
        self.order = sorted(range(len(nodes)), key=lambda i: (n[i], nodes[i]))
        self.n, self.side, self.similar = np.array([n[i] for i in self.order]), np.array([side[i] for i in self.order]), similar
        self.maps = [bits[i] for i in self.order]
        wide = np.array([len(b) for b in self.maps])
        # sizes ascend, and so do bitmaps: all of a width or more, folded to it
        self.stacked = {w: np.stack([folded(b, w) for b in self.maps[int(np.argmax(wide >= w)) :]]) for w in set(wide.tolist())}
        self.across = len(set(side)) > 1
        self.up = list(range(len(nodes)))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def unite(self, i: int, k: int) -> bool:
        a, b = self.top(i), self.top(k)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def allowed(self) -> Iterator[tuple[int, list[int]]]:
        """Each place, and the later ones of the other side (of one block: all) that sizes and bitmaps allow, the most similar first."""
        num, den = self.similar
        for i in range(len(self.n)):
            j = np.arange(i + 1, int(np.searchsorted(self.n, self.n[i] * den // num, "right")))
            if self.across:
                j = j[self.side[j] != self.side[i]]
            if len(j):
                rows = self.stacked[len(self.maps[i])]
                difference = np.bitwise_count(rows[j - (len(self.n) - len(rows))] ^ self.maps[i]).sum(axis=1, dtype=np.int64)
                left = may_differ(self.n[j], self.n[i], self.similar) - difference
                good = np.flatnonzero(left >= 0)
                yield i, j[good[np.argsort(-left[good], kind="stable")]].tolist()


def possible(nodes: list[int], n: list[int], bits: list[np.ndarray], side: list[int], similar: tuple[int, int] = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest of the pairs between two blocks (side 0 and 1), or within one (all 0), that may be similar."""
    block = _Block(nodes, n, bits, side, similar)
    return [(nodes[block.order[i]], nodes[block.order[k]]) for i, others in block.allowed() for k in others if block.unite(i, k)]


def linked(nodes: list[int], sets: list[np.ndarray], side: list[int], similar: tuple[int, int] = SIMILAR) -> list[tuple[int, int]]:
    """The same of the pairs that are similar."""
    block = _Block(nodes, [len(s) for s in sets], [bitmap(s) for s in sets], side, similar)
    out = []
    for i, others in block.allowed():
        for k in others:
            if block.top(i) != block.top(k) and similar_sets(sets[block.order[i]], sets[block.order[k]], similar):
                block.unite(i, k)
                out.append((nodes[block.order[i]], nodes[block.order[k]]))
    return out


def _by_block_pairs(rows: DataFrame, run, weight: Column, blocks: tuple[int, int, int]) -> DataFrame:
    """rows: node, label (of its group), n, and packed data, which weighs ``weight``. Deals each group of two nodes or more into
    blocks and gives run(nodes, n, data, side) each pair of them: pairs (u, v)."""
    least, most, many = blocks
    groups = rows.groupBy("label").agg(F.sum(weight).alias("weight"), F.count("*").alias("members"))
    dealt_in = F.greatest(F.least(F.ceil(F.col("weight") / least), F.lit(many)), F.ceil(F.col("weight") / most))
    blocks = groups.where("members > 1").select("label", dealt_in.cast("int").alias("blocks"))
    dealt = rows.join(blocks, "label").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = meets.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "data")

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = key[1].as_py()
        nodes, n, data, side = [], [], [], []
        for batch in batches:
            side += [int(x != first) for x in batch.column(3).to_pylist()]
            nodes += batch.column(4).to_pylist()
            n += batch.column(5).to_pylist()
            data += [np.frombuffer(x, np.uint64) for x in batch.column(6).to_pylist()]
        pairs = run(nodes, n, data, side)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], names=["u", "v"])

    # ranges of units, so that the block pairs of a large group are spread evenly
    return units.repartitionByRange(2 * shuffle_partitions(rows.sparkSession), "label", "i", "j").groupBy("label", "i", "j").applyInArrow(compare, "u long, v long")


def groups_that_may_link(edges: DataFrame, nodes: DataFrame, there: int, similar: tuple[int, int]) -> DataFrame:
    """node, label of the nodes that bitmaps let be similar to another node of their component of the edges, in groups of these."""
    first = components(edges, there)
    rows = held(first.join(nodes.select("node", "n", F.col("bits").alias("data")), "node"))
    groups = components(_by_block_pairs(rows, lambda node, n, data, side: possible(node, n, data, side, similar), F.lit(1), BITMAP_BLOCKS), there)
    release(first, rows)
    return groups


def linked_nodes(sets: DataFrame, groups: DataFrame, there: int, similar: tuple[int, int]) -> DataFrame:
    """node, label of the components of similar sets, of two nodes or more."""
    # a set of the same node may come from several tasks
    rows = held(sets.join(groups, "node").dropDuplicates(["node"]).select("node", "label", F.expr("length(set) div 8").alias("n"), F.col("set").alias("data")))
    labels = components(_by_block_pairs(rows, lambda node, _, data, side: linked(node, data, side, similar), F.col("n"), SET_BLOCKS), there)
    release(rows)
    return labels


def with_nodes(docs: DataFrame, words: int) -> DataFrame:
    """The rows of docs, and weft_node: the node of the text, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.slices(T.text_column(batch)):
                found = [node_of(s) if len(s) else None for s in T.shingle_sets(data, offsets, words)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "weft_node"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("weft_node", LongType())]))


def _components_of(docs: DataFrame, words: int, similar: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, node of every document; and node, doc_id (its smallest), label (of its component) of every node."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut(facts(texts, words))
    every = found.where("k is null").select("doc_id", "n", "node", "bits")
    nodes = held(every.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("bits").alias("bits")))
    there, shingles = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # 8 bytes for each of the keys, of which there are about half as many as shingles
    parts = max(2 * shuffle_partitions(docs.sparkSession), shingles * 4 // PART_BYTES + 1)
    edges = index(texts.select("text"), parts, words, similar, frequency_levels(found)).groupBy("part").applyInArrow(_shared, "u long, v long")
    groups = groups_that_may_link(edges, nodes, there, similar)
    labels = linked_nodes(sets_of(texts.select("text"), words, node_filter(groups)), groups, there, similar)
    out = cut(nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label")), there)
    release(nodes, groups, labels)
    return every, out


def jaccard_components(docs: DataFrame, words: int = 5, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    every, nodes = _components_of(docs, words, similar)
    least = nodes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = nodes.join(least, "label").select("node", "component_id")
    linked_ = every.where("n > 0").join(of, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked_.union(every.where("n = 0").select("doc_id", "n", "doc_id"))


def one_of_each(docs: DataFrame, words: int = 5, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row of each component, with its columns: of the smallest id that is not null, and of rows that share it the one of
    the smallest node; rows without words are kept."""
    _, nodes = _components_of(docs, words, similar)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))
    kept = nodes.groupBy("label").agg(first.alias("kept")).select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.node").alias("weft_node"))
    marked = with_nodes(docs, words)
    names = [f"`{c}`" for c in docs.columns]
    same_id = F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id"))
    one = marked.join(kept.select("weft_node", "kept_id"), "weft_node").where(same_id).dropDuplicates(["weft_node"]).select(names)
    return one.unionByName(marked.where("weft_node is null").select(names))
