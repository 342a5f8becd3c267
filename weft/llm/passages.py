"""Substring dedup: fuzzy passages that repeat across documents, by collinear chaining of k-mer seeds.

Seeds are k-word windows whose hash is the smallest of ``window`` neighbours, so any common run of window + k - 1 words has a
common seed. A document has a key, the hash of its id and text. Of the documents with a seed the one of the smallest id owns it
(one of a null id only if all are null), and each place of the seed in another document gets one match with the owner, its places
paired with the owner's in order (again from the first when the owner has fewer), so a seed at any number of places yields a linear
number of matches. A task first matches what it has read with owners of its own and sends only these on, so a seed that any share
of all documents has is one document's for each task; the owners are then matched in the task of the seed's hash.

For each document and owner, matches on one diagonal merge into runs, and the runs are chained: a Fenwick tree over the owner's
positions holds the best chains that end before, the expired ones dropped, under a cost for the words a gap skips. Chains that
together cover a long enough part of the document, a share of it by seeds, are aligned word by word with the owner's text: along the
runs' diagonals, each gap at its best switch from one to the next, the ends as far as they agree. Aligned chains of one
document that touch join to passages, as long as the words that some chain matches, without those between chains, make the share of
the whole.

Defined results: a null text, or one below k words, has no seeds; a passage must have ``least`` words or more, of which 3 in 4
agree, and so must each aligned part (a chain that does not is split where it does); a repeat within one document is none (each
copy of what another document owns is one); which of several owners a passage is aligned with follows from how the input is split
into tasks; rows equal in id and text are one document, rows that share an id but not the text are documents of their own, and so
are rows with a null id (the result names them by null); other columns are not read; columns named weft_key and weft_spans are
reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import textops as T
from weft.llm.common import cut, held, parts_for, release

K, WINDOW = 5, 8
#: Stands for a null id: after all others.
LAST = (1 << 63) - 1
#: Words of a passage at least; share of aligned words that agree; words between chains that still touch.
LEAST, AGREE, TOUCH = 50, 0.75, 16
#: Share of a stretch that seeds must cover before its words are compared at all.
SEEDED = 0.25
#: Words that a gap within a chain skips at most, and what each costs in anchor words.
WIDEST_GAP, GAP_COST = 40, 0.4
#: Words beyond a chain's ends that alignment looks at; extracts start and end at multiples of STEP words.
FLANK, STEP = 24, 8
#: Seeds that a task matches and packs at once, and bytes of seeds that a part holds about.
FLUSH, PART_BYTES = 500_000, 16 << 20


def minima(h: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Which items are the smallest of some ``window`` neighbours (of all, in a shorter text)."""
    picked = np.zeros(len(h), bool)
    n = len(h) - window + 1
    if n > 0:
        text = T.owner(bounds)
        view = np.lib.stride_tricks.sliding_window_view(h, window)
        inside = np.flatnonzero(text[:n] == text[window - 1 :])
        for k in range(0, len(inside), 100_000):
            at = inside[k : k + 100_000]
            picked[at + view[at].argmin(axis=1)] = True
    for i in np.flatnonzero((np.diff(bounds) < window) & (np.diff(bounds) > 0)):
        picked[bounds[i] + int(np.argmin(h[bounds[i] : bounds[i + 1]]))] = True
    return picked


def paired(number: np.ndarray, doc: np.ndarray, word: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the seeds, once each, by (hash, number of the document, its key, word); for each of them the index of its
    owner's place among these, and whether it is the owner's itself."""
    order = np.lexsort((word, doc, number, h))
    doc, word, h = doc[order], word[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
    order, doc, h = order[new], doc[new], h[new]
    every = np.arange(len(h))
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else every
    head = np.repeat(first, np.diff(np.append(first, len(h))))
    start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else every
    count = np.diff(np.append(start, len(h)))
    place = every - np.repeat(start, count)
    owned = np.zeros(len(h), np.int64)
    owned[start] = count
    return order, head + place % np.maximum(owned[head], 1), doc == doc[head]


def seeds(texts: DataFrame, parts: int) -> DataFrame:
    """texts: doc (key), number (id), text. part, and packed: keys and numbers of documents, then for each seed the place of its document, its first word and its
    hash; a row without hashes has matches of the task's own: documents, their words, the owners and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        numbers: list[np.ndarray] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        texts_ = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal texts_, size
            if not held:
                return
            place, word, h = (np.concatenate(x) for x in zip(*held, strict=True))
            every, number = np.concatenate(ids), np.concatenate(numbers)
            order, owner, own = paired(number[place], every[place], word, h)
            place, word, h = place[order], word[order], h[order]
            other = np.flatnonzero(~own)
            for k in range(0, len(other), 100_000):
                some = other[k : k + 100_000]
                yield _seed_batch(int((len(every) + k) % parts), every[place[some]], word[some], every[place[owner[some]]], word[owner[some]], None, None)
            place, word, h = place[own], word[own], h[own]
            part = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)):
                at = order[edges[p] : edges[p + 1]]
                used, local = np.unique(place[at], return_inverse=True)
                # the part follows from the lower half of a hash; equal upper halves of different hashes only cost a look
                yield _seed_batch(int(p), every[used], word[at], local.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32), None, (h[at] >> np.uint64(32)).astype(np.uint32), number[used])
            ids.clear()
            numbers.clear()
            held.clear()
            texts_ = size = 0

        for batch in batches:
            for i, j, data, offsets in T.slices(T.text_column(batch)):
                starts, ends, bounds = T.words(data, offsets)
                grams, at = T.window_hash(T.range_hash(data, starts, ends, lower=True), bounds, K)
                first = np.searchsorted(at, bounds)
                picked = np.flatnonzero(minima(grams, first, WINDOW))
                place = T.owner(first)[picked]
                ids.append(batch.column(0).slice(i, j - i).to_numpy())
                numbers.append(pc.fill_null(batch.column(1).slice(i, j - i), LAST).to_numpy())
                held.append((place + texts_, (at[picked] - bounds[place]).astype(np.int32), grams[picked]))
                texts_ += j - i
                size += len(picked)
                if size >= FLUSH:
                    yield from flush()
        yield from flush()

    return texts.mapInArrow(run, "part long, docs binary, word binary, place binary, other_word binary, hash binary, numbers binary")


def _seed_batch(part: int, *columns: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), *(pa.array([None if x is None else x.tobytes()], pa.binary()) for x in columns)], names=["part", "docs", "word", "place", "other_word", "hash", "numbers"])


def _match_batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "word", "other", "other_word"])


def _matches(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each seed that two documents or more have: (document, its word, owner, the owner's word)."""
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in rows:
        for docs, word, place, other_word, h, number in zip(*batch.columns[1:], strict=True):
            doc, word = np.frombuffer(docs.as_buffer(), np.int64), np.frombuffer(word.as_buffer(), np.int32)
            if h.is_valid:
                at = np.frombuffer(place.as_buffer(), np.uint16 if len(place.as_buffer()) < 4 * len(word) else np.uint32)
                parts.append((np.frombuffer(number.as_buffer(), np.int64)[at], doc[at], word, np.frombuffer(h.as_buffer(), np.uint32)))
            else:
                yield _match_batch(doc, word, np.frombuffer(place.as_buffer(), np.int64), np.frombuffer(other_word.as_buffer(), np.int32))
    if not parts:
        return
    number, doc, word, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(h), bool)
    again[1:] = h[order[1:]] == h[order[:-1]]
    again[:-1] |= again[1:]
    some = order[again]
    number, doc, word, h = number[some], doc[some], word[some], h[some]
    order, owner, own = paired(number, doc, word, h)
    doc, word = doc[order], word[order]
    for k in range(0, len(doc), 50_000):
        some = np.flatnonzero(~own[k : k + 50_000]) + k
        if len(some):
            yield _match_batch(doc[some], word[some], doc[owner[some]], word[owner[some]])


class Fenwick:
    """Largest value, with its item, over prefixes of the positions 1..n, of the items that have not expired."""

    def __init__(self, n: int, expires: np.ndarray) -> None:
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(n + 1)]
        self.expires = expires

    def put(self, at: int, value: float, item: int) -> None:
        while at < len(self.heaps):
            heappush(self.heaps[at], (-value, item))
            at += at & -at

    def most(self, at: int, now: int) -> tuple[float, int]:
        """now must not fall from one call to the next."""
        out = (float("-inf"), -1)
        while at > 0:
            heap = self.heaps[at]
            while heap and self.expires[heap[0][1]] < now:
                heappop(heap)
            if heap and -heap[0][0] > out[0]:
                out = (-heap[0][0], heap[0][1])
            at -= at & -at
        return out


def merged_runs(word: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Matches of one diagonal with small gaps, as rows (start, end, other's start)."""
    diagonal = other.astype(np.int64) - word
    order = np.lexsort((word, diagonal))
    w, d = word[order].astype(np.int64), diagonal[order]
    new = np.ones(len(w), bool)
    new[1:] = (d[1:] != d[:-1]) | (w[1:] - w[:-1] > K + WINDOW)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(w)) - 1
    runs = np.stack([w[first], w[last] + K, w[first] + d[first]], axis=1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def chain(runs: np.ndarray) -> list[np.ndarray]:
    """Disjoint collinear chains of runs, the best first. A run may follow one that ends at most K - 1 words after its start in
    both texts, starts before it in both, and ends at most WIDEST_GAP words before it in the document. The cost of a gap
    is linear in the words skipped on both sides, so that it splits into a term of the end of one run and one of the start of the next."""
    if len(runs) == 1:
        return [runs]
    score, back = chain_scores(runs)
    used = np.zeros(len(runs), bool)
    out = []
    for i in np.argsort(-score, kind="stable"):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            out.append(runs[path[::-1]])
    return out


def chain_scores(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the best chain that ends with each run: its score, and the run before (-1: none)."""
    start, end, other = runs[:, 0], runs[:, 1], runs[:, 2]
    other_end = other + (end - start)
    places = np.unique(other_end)
    score, back = (end - start).astype(float), np.full(len(runs), -1)
    tree = Fenwick(len(places), end + WIDEST_GAP)
    by_end = np.argsort(end, kind="stable")
    done = 0
    for i in range(len(runs)):  # by start; all runs of K words, so one that ends at most K - 1 words after a start starts before it
        while done < len(runs) and end[by_end[done]] <= start[i] + K - 1:
            j = int(by_end[done])
            tree.put(int(np.searchsorted(places, other_end[j])) + 1, float(score[j] + GAP_COST / 2 * (end[j] + other_end[j])), j)
            done += 1
        value, j = tree.most(int(np.searchsorted(places, other[i] + K - 1, "right")), int(start[i]))
        if j >= 0 and (gained := value - GAP_COST / 2 * (start[i] + other[i])) > 0:
            score[i] += gained
            back[i] = j
    return score, back


def joined(spans: list[tuple[int, int]], touch: int) -> list[tuple[int, int]]:
    """Union of spans, those with at most ``touch`` words between made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + touch:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each document, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None

    def given() -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        return {c: table[c].to_numpy() for c in table.column_names}

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held and ids[a] != last:
                yield given()
                held = []
            held.append(batch.slice(a, b - a))
            last = ids[a]
    if held:
        yield given()


def seeded(runs: np.ndarray) -> np.ndarray:
    """Which words from a chain's start to its end its runs cover."""
    out = np.zeros(int(runs[:, 1].max() - runs[0, 0]), bool)
    for a, b, _ in runs - np.array([runs[0, 0], runs[0, 0], 0]):
        out[a:b] = True
    return out


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for m in _by_document(batches):
        order = np.argsort(m["other"], kind="stable")
        other = m["other"][order]
        edges = np.append(np.flatnonzero(np.concatenate([[True], other[1:] != other[:-1]])), len(other))
        found = []
        for a, b in zip(edges, edges[1:], strict=False):
            at = order[a:b]
            found += [(int(other[a]), c) for c in chain(merged_runs(m["word"][at], m["other_word"][at]))]
        start, end = (np.array([x(c) for _, c in found]) for x in (lambda c: int(c[0, 0]), lambda c: int(c[:, 1].max())))
        near = united(start, end, [seeded(c) for _, c in found], LEAST - 2 * TOUCH, SEEDED, 2 * TOUCH)
        for (who, c), a, b, there in zip(found, start.tolist(), end.tolist(), near, strict=True):
            if there:
                o = int(c[0, 2])
                oz = int((c[:, 2] + c[:, 1] - c[:, 0]).max())
                low = [max(0, v - FLANK) // STEP * STEP for v in (a, o)]
                high = [-(-(v + FLANK) // STEP) * STEP for v in (b, oz)]
                rows.append((int(m["doc"][0]), who, low[0], high[0], low[1], high[1], c.astype(np.int64).tobytes()))
        if len(rows) > 2000:
            yield _chain_batch(rows)
            rows = []
    if rows:
        yield _chain_batch(rows)


CHAIN_SCHEMA = "doc long, other long, a long, z long, other_a long, other_z long, runs binary"


def _chain_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], names=["doc", "other", "a", "z", "other_a", "other_z", "runs"])


def widest(start: np.ndarray, end: np.ndarray, gain: np.ndarray, least: int) -> list[tuple[int, int] | None]:
    """For each part, its passage if it has one. gain: prefix sums over words, that do not fall over a span which agrees enough.
    The longest such span of ``least`` words from a part's start to a part's end comes first, then those of the parts before
    and after it. A part of ``least`` words that agrees enough is always in one."""
    out: list[tuple[int, int] | None] = [None] * len(start)
    todo = [np.arange(len(start))]
    while todo:
        at = todo.pop()
        starts, ends = np.unique(start[at]), np.unique(end[at])
        # the first start that a span to each end may have: where the running minimum of gain gets as low as the end's
        first = np.searchsorted(-np.minimum.accumulate(gain[starts]), -gain[ends])
        length = np.where(first < len(starts), ends - starts[np.minimum(first, len(starts) - 1)], 0)
        k = int(length.argmax())
        if length[k] < least:
            continue
        a, b = int(starts[first[k]]), int(ends[k])
        for i in at[(start[at] >= a) & (end[at] <= b)]:
            out[i] = (a, b)
        todo += [x for x in (at[start[at] < a], at[end[at] > b]) if len(x)]
    return out


def united(start: np.ndarray, end: np.ndarray, same: list[np.ndarray], least: int, agree: float, touch: int = TOUCH) -> list[tuple[int, int] | None]:
    """For each part of a document, with the words of it that agree, the passage it belongs to."""
    out: list[tuple[int, int] | None] = [None] * len(start)
    for a, b in joined(list(zip(start.tolist(), end.tolist(), strict=True)), touch):
        if b - a < least:
            continue
        at = np.flatnonzero((start >= a) & (end <= b))
        matched = np.zeros(b - a, bool)
        for i in at:
            matched[start[i] - a : end[i] - a] |= same[i]
        gain = np.concatenate([[0], np.cumsum(matched)]) - agree * np.arange(b - a + 1)
        for i, span in zip(at, widest(start[at] - a, end[at] - a, np.round(gain, 6), least), strict=True):
            out[i] = span and (span[0] + a, span[1] + a)
    return out


def align(x: np.ndarray, y: np.ndarray, runs: np.ndarray) -> tuple[int, int, int, int, np.ndarray]:
    """(start, end) in x and y of the chain's alignment, and which words of x agree. Between two runs, the alignment leaves the
    first one's diagonal for the second one's where most words agree; beyond the ends it goes on while that gains."""

    def agree(a: int, b: int, d: int) -> np.ndarray:
        i = np.arange(a, b)
        good = (i >= 0) & (i < len(x)) & (i + d >= 0) & (i + d < len(y))
        out = np.zeros(len(i), bool)
        out[good] = x[i[good]] == y[i[good] + d]
        return out

    diagonal = runs[:, 2] - runs[:, 0]
    d = int(diagonal[0])
    before = agree(int(runs[0, 0]) - FLANK, int(runs[0, 0]), d)[::-1]
    gain = np.cumsum(np.where(before, 1, -2))
    start = int(runs[0, 0]) - (int(gain.argmax()) + 1 if len(gain) and gain.max() > 0 else 0)
    at, same = start, [np.zeros(0, bool)]
    for k in range(len(runs)):
        d, end = int(diagonal[k]), int(runs[k, 1])
        if k + 1 < len(runs):
            following = int(diagonal[k + 1])
            a, b = min(max(at, end - K), int(runs[k + 1, 0])), int(runs[k + 1, 0])
            a = max(a, at)
            here, there = agree(a, b, d), agree(a, b, following)
            total = np.concatenate([[0], np.cumsum(here)]) + np.concatenate([np.cumsum(there[::-1])[::-1], [0]])
            switch = a + int(total.argmax())
            same.append(agree(at, switch, d))
            at = max(at, switch)
        else:
            after = np.cumsum(np.where(agree(end, end + FLANK, d), 1, -2))
            end += int(after.argmax()) + 1 if len(after) and after.max() > 0 else 0
            same.append(agree(at, end, d))
            at = max(at, end)
    return start, at, start + int(diagonal[0]), at + d, np.concatenate(same)


def agreeing(runs: np.ndarray, start: int, end: int, other: int, other_end: int, same: np.ndarray, agree: float) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """The alignment, if its words agree enough; or else its longest stretches, from one run's start to another's end, that do."""
    if end <= start:
        return
    if same.sum() >= agree * (end - start):
        yield start, end, other, other_end, same
        return
    first, last = runs[:, 0].clip(start, end) - start, runs[:, 1].clip(start, end) - start
    first[0], last[-1] = 0, end - start
    inside = last > first
    first, last, diagonal = first[inside], last[inside], (runs[:, 2] - runs[:, 0])[inside]
    gain = np.round(np.concatenate([[0], np.cumsum(same)]) - agree * np.arange(len(same) + 1), 6)
    for a, b in sorted({w for w in widest(first, last, gain, K) if w}):
        of = np.flatnonzero((first >= a) & (last <= b))
        while a and same[a - 1]:
            a -= 1
        while b < len(same) and same[b]:
            b += 1
        yield start + a, start + b, start + a + int(diagonal[of[0]]), start + b + int(diagonal[of[-1]]), same[a:b]


def with_keys(docs: DataFrame) -> DataFrame:
    """The rows of docs, and weft_key: the document's key."""
    return docs.withColumn("weft_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


PARTS = ["doc", "other", "part_start", "part_end", "other_start", "other_end", "n_agree"]
SPANS = ["doc", "start_word", "end_word", "n_parts", *PARTS[1:]]


def _spans(docs: DataFrame, least: int, agree: float) -> DataFrame:
    """One row for each passage: the document's key, start and end, how many aligned parts it has, and the part of most words."""
    texts = with_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")).select(F.col("weft_key").alias("doc"), F.col("doc_id").alias("number"), "text")
    # written, not held, so that the shuffles of seeds and matches can go while words are compared
    found = seeds(texts, parts_for(docs, PART_BYTES)).groupBy("part").applyInArrow(_matches, "doc long, word int, other long, other_word int")
    chains = cut(found.repartition("doc").sortWithinPartitions("doc").mapInArrow(_chains, CHAIN_SCHEMA))
    wanted = chains.select("doc", "a", "z").union(chains.select("other", "other_a", "other_z")).distinct().groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("ranges"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ranges = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j, data, offsets in T.slices(T.text_column(batch)):
                starts, ends, bounds = T.words(data, offsets)
                h = T.range_hash(data, starts, ends, lower=True)
                rows = [(ids[r], g["a"], g["z"], h[bounds[r - i] : bounds[r - i + 1]][g["a"] : g["z"]].astype(np.uint32).tobytes()) for r in range(i, j) for g in ranges[r]]
                c = list(zip(*rows, strict=True))
                if c:
                    yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in c[:3]), pa.array(c[3], pa.binary())], names=["doc", "a", "z", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, other, a, o, runs, x, y in zip(*(batch.column(c).to_pylist() for c in ("doc", "other", "a", "other_a", "runs", "words", "other_words")), strict=True):
                at = np.frombuffer(runs, np.int64).reshape(-1, 3) - np.array([a, a, o])
                for s, e, os, oe, same in agreeing(at, *align(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), at), agree):
                    rows.append((doc, other, s + a, e + a, os + o, oe + o, int(same.sum()), np.packbits(same).tobytes()))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], names=[*PARTS, "same"])

    once = texts.join(wanted, "doc").dropDuplicates(["doc"])
    words = held(once.select("doc", "text", "ranges").mapInArrow(extract, "doc long, a long, z long, words binary"))
    own = words.hint("merge")
    others = words.select(F.col("doc").alias("other"), F.col("a").alias("other_a"), F.col("z").alias("other_z"), F.col("words").alias("other_words")).hint("merge")
    aligned = chains.join(own, ["doc", "a", "z"]).join(others, ["other", "other_a", "other_z"]).select("doc", "other", "a", "other_a", "runs", "words", "other_words").mapInArrow(run, ", ".join(f"{c} long" for c in PARTS) + ", same binary")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[int]] = []
        for m in _by_document(batches):
            start, end = m["part_start"], m["part_end"]
            same = [np.unpackbits(np.frombuffer(x, np.uint8), count=e - s).astype(bool) for x, s, e in zip(m["same"], start, end, strict=True)]
            of: dict[tuple[int, int], list[int]] = {}
            for i, w in enumerate(united(start, end, same, least, agree)):
                if w:
                    of.setdefault(w, []).append(i)
            for w, parts in of.items():
                best = max(parts, key=lambda i: (m["n_agree"][i], -m["other"][i], -start[i], -end[i]))
                rows.append([int(m["doc"][0]), *w, len(parts), *(int(m[c][best]) for c in PARTS[1:])])
            if len(rows) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=SPANS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=SPANS)

    out = cut(aligned.repartition("doc").sortWithinPartitions("doc", "part_start", "other").mapInArrow(unite, ", ".join(f"{c} long" for c in SPANS)))
    release(chains, words)
    return out


RESULT = ["doc_id", "start_word", "end_word", "n_parts", "other_doc_id", *PARTS[2:]]


def passages(docs: DataFrame, least: int = LEAST, agree: float = AGREE) -> DataFrame:
    """A row for each passage: doc_id, start_word and end_word, n_parts (aligned with owners), and of the part of most agreeing
    words: other_doc_id, part_start, part_end, other_start, other_end, n_agree. Words count from 0, ends are exclusive."""
    names = with_keys(docs.select("doc_id", "text").where("text is not null")).select("weft_key", F.col("doc_id").cast("long").alias("doc_id")).distinct()
    spans = _spans(docs, least, agree).join(names.select(F.col("weft_key").alias("doc"), "doc_id"), "doc")
    return spans.join(names.select(F.col("weft_key").alias("other"), F.col("doc_id").alias("other_doc_id")), "other").select(RESULT)


def without_repeats(docs: DataFrame, least: int = LEAST, agree: float = AGREE) -> DataFrame:
    """The documents, each without the passages that repeat one of their owner; what ends up without a word goes.
    n_chars, where there is one, counts again."""
    spans = _spans(docs, least, agree).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("weft_spans"))
    names = docs.columns
    rest = with_keys(docs).join(spans.withColumnRenamed("doc", "weft_key"), "weft_key", "left").select(*(f"`{c}`" for c in names), "weft_spans")
    count = names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_at = batch.schema.get_field_index("text")
            texts, spans_ = batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            keep = np.ones(len(texts), bool)
            sizes = batch.column(count).to_pylist() if count >= 0 else []
            for r, given in enumerate(spans_):
                if given:
                    texts[r] = _removed(texts[r], [(g["start_word"], g["end_word"]) for g in given])
                    keep[r] = bool(texts[r].strip())
                    if sizes:
                        sizes[r] = len(texts[r])
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if sizes:
                columns[count] = pa.array(sizes, batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(keep))

    return rest.mapInArrow(run, docs.schema)


def _removed(text: str, spans: list[tuple[int, int]]) -> str:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = T.words(data, np.array([0, len(data)]))
    keep = np.ones(len(data), bool)
    for a, b in spans:
        if a < len(starts):
            keep[starts[a] : starts[b] if b < len(starts) else len(data)] = False
    return data[keep].tobytes().decode()
