"""LM scoring with a Brown class-based bigram model.

P(token | before) = P(class | history) * P(token | class). Every word of the training texts has a class; the history is the class of
the token before where that word makes 1/LISTED of all tokens or more, else the class of its form (digit, sign, sentence
end, non-ASCII bytes), and a class of its own at the start of a text. Exchange clustering moves the words that make 1/CORE of all
tokens or more between classes until none moves; then every other word, from its counted neighbours in all training texts, takes the
class under which they are likeliest, if they are EVIDENCE likelier (as a logarithm) than under the class of its form, or else that.
An unseen word has the class of its form; the end of a text is a class.

With smoothed counts n(w) + SMOOTH for words, SMOOTH for an unseen word of each form, a class's weight Z(c) is the sum over its
words, s(c) its share of all weight, P(w | c) = (n(w) + SMOOTH) / Z(c) and P(c | h) = (n(h, c) + BACKOFF s(c)) / (n(h) + BACKOFF): the
probabilities after any history sum to 1 over all words, the end and an unseen word of each form.

Five passes over the texts. (1) Tasks count their words and send them, packed, to the task of their hash: the vocabulary with exact
counts. The driver takes the listed words, at most LISTED by definition, of which the core is at most CORE. (2) Bigrams of the core
and the forms. (3) Words beyond the core are sent with their neighbours' classes: each gets its class. (4) Pairs of history and
class are counted; words that are not listed are sent to the vocabulary's parts. (5) Texts are scored; words that are not listed
are sent with their text's number, and their sums come back by text. What is shuffled grows with the corpus, what the driver gets is
bounded. A task sends a word once for all it holds of it, so no part gets a hot word's tokens but as counts, or as neighbours of two
bytes each below the core.

Defined results: a null or empty text is one end token; a null id is held out of nothing; with no training text N and V are 0
and every token scores 1 under smoothing; repeated rows are scored, and learned from, each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import textops as T
from weft.llm.common import cut, fold, parts_for, small_batches

#: One over the least share of the tokens of a word of the core, and of a listed word.
CORE, LISTED = 2500, 1 << 17
CLASSES = 64
FORMS = 16
SMOOTH = 0.1
BACKOFF = 20.0
EVIDENCE = 12.0
#: Tokens that a task packs at once, and bytes of text to a part.
FLUSH, PART_BYTES = 1_000_000, 32 << 20
#: Parts in which tables are summed.
RANGES = 16
#: Words whose neighbours are gathered at once.
BLOCK = 4096


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and form of every word, and each text's first."""
    starts, ends, bounds = T.words(data, offsets)
    h = T.range_hash(data, starts, ends, lower=True)
    total = np.zeros(len(data) + 1, np.int32)
    form = np.isin(data[ends - 1], np.frombuffer(b".!?:;,", np.uint8)).astype(np.int64)
    for bit, mask in ((2, (data >= 48) & (data < 58)), (4, data >= 128), (8, np.isin(data, np.frombuffer(b"#*$%&|<>@", np.uint8)))):
        np.cumsum(mask, out=total[1:])
        form += bit * (total[ends] > total[starts])
    return h, form, bounds


class Words:
    """Some words by hash, with counts and classes."""

    def __init__(self, h: np.ndarray, count: np.ndarray, cls: np.ndarray | None = None) -> None:
        order = np.argsort(h)
        self.h, self.count, self.cls = h[order], count[order], None if cls is None else cls[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and which are there."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h


def with_ends(values: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of all texts with ``end`` after each text, and the new bounds."""
    texts = len(bounds) - 1
    out = np.full(len(values) + texts, end, np.int64)
    out[np.arange(len(values)) + T.owner(bounds)] = values
    return out, bounds + np.arange(texts + 1)


def before(values: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """The value before each one, ``start`` before each text's first."""
    out = np.roll(values, 1)
    out[bounds[:-1]] = start
    return out


# ---- (1) the vocabulary


def _packed(part: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=["part", *"abcde"[: len(columns)]])


def by_part(h: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the hashes of each part, ordered by hash."""
    part = ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((h, part))
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), order[edges[p] : edges[p + 1]]


def vocabulary(train: DataFrame, parts: int) -> DataFrame:
    """part, h, n: the words of each part, sorted, with exact counts over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                words, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                for p, at in by_part(words, parts):
                    yield _packed(p, words[at], n[at].astype(np.uint32))

        size = 0
        for batch in batches:
            for _, _, data, offsets in T.slices(T.text_column(batch)):
                held.append(_tokens(data, offsets)[0])
                size += len(held[-1])
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = [], []
        for batch in rows:
            for x, y in zip(batch.column(1), batch.column(2), strict=True):
                h.append(np.frombuffer(x.as_buffer(), np.uint64))
                n.append(np.frombuffer(y.as_buffer(), np.uint32))
        words, at = np.unique(np.concatenate(h), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(n), minlength=len(words)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([words.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary()), pa.array([len(words)]), pa.array([int(total.sum())])], names=["part", "h", "n", "words", "tokens"])

    return train.mapInArrow(count, "part long, a binary, b binary").groupBy("part").applyInArrow(add, "part long, h binary, n binary, words long, tokens long")


def frequent(words: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Hashes, counts and, where there are any, classes of the words with ``least`` tokens or more."""
    classed = "cls" in words.columns

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["n"], np.int64)
                at = np.flatnonzero(n >= least)
                if len(at):
                    yield _packed(row["part"], np.frombuffer(row["h"], np.uint64)[at], n[at], np.frombuffer(row["cls"], np.uint8)[at] if classed else np.empty(0, np.uint8))

    got = words.mapInArrow(pick, "part long, a binary, b binary, c binary").collect()
    h, n, cls = (np.frombuffer(b"".join(r[k] for r in got), t) for k, t in (("a", np.uint64), ("b", np.int64), ("c", np.uint8)))
    return h, n, cls if classed else None


# ---- tables that tasks count


def _table_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A table's counts, by range."""
    step = -(-len(total) // RANGES)
    for k in range(RANGES):
        part = total[k * step : (k + 1) * step]
        at = np.flatnonzero(part)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([-1 - k]), *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), part[at].astype(np.int64)))], names=["part", "a", "b"])


def _table_sum(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all rows part, a, b of ``_table_rows``."""
    step = -(-size // RANGES)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(step, np.int64)
        for batch in batches:
            for at, n in zip(batch.column(1), batch.column(2), strict=True):
                total[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(n.as_buffer(), np.int64)
        yield _packed(key[0].as_py(), total)

    out = np.zeros(step * RANGES, np.int64)
    for r in rows.groupBy("part").applyInArrow(add, "part long, a binary").collect():
        k = -1 - r["part"]
        out[k * step : (k + 1) * step] = np.frombuffer(r["a"], np.int64)
    return out[:size]


# ---- (2) exchange clustering of the core


def bigram_counts(train: DataFrame, core: Words) -> np.ndarray:
    """Exact counts of (symbol before, symbol); symbols are the core's words, then forms, then the end of a text."""
    size = len(core.h) + FORMS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for _, _, data, offsets in T.slices(T.text_column(batch)):
                symbols, bounds = _symbols(data, offsets, core)[:2]
                at, n = np.unique(before(symbols, bounds, size - 1) * size + symbols, return_counts=True)
                total[at] += n
        yield from _table_rows(total)

    return _table_sum(train.mapInArrow(count, "part long, a binary, b binary"), size * size).reshape(size, size)


def _symbols(data: np.ndarray, offsets: np.ndarray, core: Words) -> tuple[np.ndarray, ...]:
    """Symbols and bounds of all tokens; of the words hash, form and whether they are of the core."""
    h, form, bounds = _tokens(data, offsets)
    at, known = core.find(h)
    symbols, ends = with_ends(np.where(known, at, len(core.h) + form), bounds, len(core.h) + FORMS)
    return symbols, ends, h, form, known


def exchange(bigrams: np.ndarray, words: int, classes: int = CLASSES, sweeps: int = 4) -> np.ndarray:
    """Class of each symbol: the first ``words`` are moved one by one to the class that raises the likelihood most, until
    none moves; each later symbol keeps a class of its own."""
    size = len(bigrams)
    classes = max(1, min(classes, words))
    weight = bigrams.sum(0) + bigrams.sum(1)
    cls = np.empty(size, np.int64)
    cls[np.argsort(-weight[:words], kind="stable")] = np.arange(words) % classes
    cls[words:] = classes + np.arange(size - words)
    total = classes + size - words

    def xlogx(v: np.ndarray) -> np.ndarray:
        return v * np.log(np.maximum(v, 1))

    out_to = np.zeros((size, total))  # by symbol, counts towards each class
    in_from = np.zeros((size, total))
    for s in range(size):
        out_to[:, cls[s]] += bigrams[:, s]
        in_from[:, cls[s]] += bigrams[s, :]
    table = np.zeros((total, total))
    np.add.at(table, cls, out_to)
    for _ in range(sweeps):
        moved = 0
        for w in np.argsort(-weight[:words], kind="stable"):
            if not weight[w]:
                continue
            old, o, i, own = cls[w], out_to[w].copy(), in_from[w].copy(), float(bigrams[w, w])
            o[old] -= own
            i[old] -= own
            table[old, :] -= o
            table[:, old] -= i
            table[old, old] -= own
            row, col = table.sum(1), table.sum(0)
            c = np.arange(classes)
            gain = (xlogx(table[:classes] + o) - xlogx(table[:classes])).sum(1) + (xlogx(table[:, :classes].T + i) - xlogx(table[:, :classes].T)).sum(1)
            corner = table[c, c]
            gain += xlogx(corner + o[c] + i[c] + own) - xlogx(corner + o[c]) - xlogx(corner + i[c]) + xlogx(corner)
            gain -= xlogx(row[c] + o.sum() + own) - xlogx(row[c]) + xlogx(col[c] + i.sum() + own) - xlogx(col[c])
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new, :] += o
            table[:, new] += i
            table[new, new] += own
            if new != old:
                moved += 1
                cls[w] = new
                out_to[:, old] -= bigrams[:, w]
                out_to[:, new] += bigrams[:, w]
                in_from[:, old] -= bigrams[w, :]
                in_from[:, new] += bigrams[w, :]
        if not moved:
            break
    return cls


# ---- (3) classes of all other words


def neighbour_logs(bigrams: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """By neighbour (class before, then class after) and class of a word: log of how likely the class has the neighbour."""
    total = int(cls.max()) + 1
    classes = total - 1
    table = np.zeros((total, total))
    np.add.at(table, (cls[:, None], cls[None, :]), bigrams)
    share_in, share_out = ((table.sum(k) + 1) / (table.sum() + total) for k in (1, 0))
    left = (table[:, :classes] + BACKOFF * share_in[:, None]) / (table[:, :classes].sum(0) + BACKOFF)
    right = (table[:classes] + BACKOFF * share_out) / (table[:classes].sum(1, keepdims=True) + BACKOFF)
    return np.log(np.concatenate([left, right.T]))


def chosen(counts: np.ndarray, logs: np.ndarray, form: np.ndarray) -> np.ndarray:
    """Class of each word, from its neighbours' counts and its form."""
    fits = np.round(counts @ logs, 6)
    core = fits.shape[1] - FORMS
    own = core + form.astype(np.int64)
    if not core:
        return own
    best = np.argmax(fits[:, :core], axis=1)
    every = np.arange(len(fits))
    return np.where(fits[every, best] - fits[every, own] > EVIDENCE, best, own)


def classed(train: DataFrame, words: DataFrame, core: Words, cls: np.ndarray, bigrams: np.ndarray, parts: int) -> DataFrame:
    """part, h, n, cls of the whole vocabulary."""
    total = int(cls.max()) + 1
    logs = neighbour_logs(bigrams, cls)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, form, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                for p, at in by_part(h, parts):
                    own, first, n = np.unique(h[at], return_index=True, return_counts=True)
                    yield _packed(p, own, n.astype(np.uint32), left[at], right[at], form[at[first]])

        size = 0
        for batch in batches:
            for _, _, data, offsets in T.slices(T.text_column(batch)):
                symbols, bounds, h, form, known = _symbols(data, offsets, core)
                c = cls[symbols]
                at = (np.arange(len(h)) + T.owner(bounds - np.arange(len(bounds))))[~known]
                held.append((h[~known], form[~known].astype(np.uint8), before(c, bounds, total - 1)[at].astype(np.uint8), c[at + 1].astype(np.uint8)))
                size += len(at)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    def choose(key: tuple, rows: pa.Table, own: pa.Table) -> pa.Table:
        vocabulary_ = np.frombuffer(own["h"][0].as_py(), np.uint64)
        of, side, form = [], [[], []], np.zeros(len(vocabulary_), np.uint8)
        for h, n, left, right, forms in zip(*(rows[c].to_pylist() for c in "abcde"), strict=True):
            at = np.searchsorted(vocabulary_, np.frombuffer(h, np.uint64))
            form[at] = np.frombuffer(forms, np.uint8)
            of.append(np.repeat(at, np.frombuffer(n, np.uint32)))
            side[0].append(np.frombuffer(left, np.uint8))
            side[1].append(np.frombuffer(right, np.uint8))
        of, left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (of, *side))
        order = np.argsort(of, kind="stable")
        of, left, right = of[order], left[order].astype(np.int64), right[order].astype(np.int64)
        out = np.zeros(len(vocabulary_), np.uint8)
        for k in range(0, len(vocabulary_), BLOCK):
            a, b = np.searchsorted(of, [k, k + BLOCK])
            place = (of[a:b] - k) * (2 * total)
            counts = np.bincount(np.concatenate([place + left[a:b], place + total + right[a:b]]), minlength=BLOCK * 2 * total).reshape(BLOCK, 2 * total)
            some = form[k : k + BLOCK]
            out[k : k + BLOCK] = chosen(counts[: len(some)], logs, some)
        at, known = core.find(vocabulary_)
        out[known] = core.cls[at[known]]
        return own.select(["part", "h", "n"]).append_column("cls", pa.array([out.tobytes()], pa.binary()))

    sent = train.mapInArrow(send, "part long, a binary, b binary, c binary, d binary, e binary")
    return sent.groupBy("part").cogroup(words.select("part", "h", "n").groupBy("part")).applyInArrow(choose, "part long, h binary, n binary, cls binary")


# ---- (4) histories and classes


class Model:
    """What all tasks know: the listed words with counts and classes, and numbers of classes. Classes of tokens: those of words, of
    which the last are those of the forms, and the end. Histories: classes of words, the start of a text."""

    def __init__(self, listed: Words, classes: int) -> None:
        self.listed, self.classes = listed, classes
        self.end, self.histories = classes, classes + 1

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of all words: hash, form, place in the list and whether it is there; and of all tokens, ends included: history, bounds, and the places of words."""
        h, form, bounds = _tokens(data, offsets)
        at, known = self.listed.find(h)
        own = np.where(known, self.listed.cls[at] if len(self.listed.h) else 0, self.classes - FORMS + form)
        tokens, ends = with_ends(own, bounds, 0)
        return h, form, at, known, before(tokens, ends, self.histories - 1), ends, np.arange(len(h)) + T.owner(bounds)


def history_counts(train: DataFrame, words: DataFrame, model: Model, parts: int) -> np.ndarray:
    """Counts of (history, class) over all training tokens."""
    width = model.classes + 1
    size = model.histories * width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, history = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                for p, at in by_part(h, parts):
                    own, n = np.unique(h[at], return_counts=True)
                    yield _packed(p, own, n.astype(np.uint32), history[at])

        rest = 0
        for batch in batches:
            for _, _, data, offsets in T.slices(T.text_column(batch)):
                h, form, at, known, history, ends, place = model.read(data, offsets)
                total += np.bincount(history[place[known]] * width + model.listed.cls[at[known]], minlength=size) if len(model.listed.h) else 0
                total += np.bincount(history[ends[1:] - 1] * width + model.end, minlength=size)
                held.append((h[~known], history[place[~known]].astype(np.uint8)))
                rest += len(held[-1][0])
                if rest >= FLUSH:
                    yield from flush()
                    rest = 0
        yield from flush()
        for row in _table_rows(total):
            yield row.append_column("c", pa.nulls(1, pa.binary()))

    def classify(key: tuple, rows: pa.Table, own: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return rows.select(["part", "a", "b"])
        total = np.zeros(size, np.int64)
        if own.num_rows:
            h, cls = np.frombuffer(own["h"][0].as_py(), np.uint64), np.frombuffer(own["cls"][0].as_py(), np.uint8)
            for x, n, history in zip(*(rows[c].to_pylist() for c in "abc"), strict=True):
                c = np.repeat(cls[np.searchsorted(h, np.frombuffer(x, np.uint64))].astype(np.int64), np.frombuffer(n, np.uint32))
                total += np.bincount(np.frombuffer(history, np.uint8).astype(np.int64) * width + c, minlength=size)
        return pa.Table.from_batches(_table_rows(total), pa.schema([("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary())]))

    counted = train.mapInArrow(count, "part long, a binary, b binary, c binary").groupBy("part").cogroup(words.groupBy("part")).applyInArrow(classify, "part long, a binary, b binary")
    return _table_sum(counted, size).reshape(model.histories, width)


def class_weights(words: DataFrame, texts: int, classes: int) -> np.ndarray:
    """Sums of the smoothed counts of each class's words, unseen ones included, and of the end."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, 2), np.int64)
        for batch in batches:
            for n, cls in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.frombuffer(cls, np.uint8)
                total[:, 0] += np.bincount(c, minlength=classes)
                np.add.at(total[:, 1], c, np.frombuffer(n, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(range(classes), pa.int64()), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["cls", "words", "tokens"])

    out = np.zeros(classes + 1)
    for r in words.select("n", "cls").mapInArrow(add, "cls long, words long, tokens long").groupBy("cls").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect():
        out[r["cls"]] = r["tokens"] + SMOOTH * r["words"]
    out[classes - FORMS : classes] += SMOOTH
    out[classes] = texts + SMOOTH
    return out


def transition_logs(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """log10 of P(class | history) / Z(class), by history and class; 0 for a class without words."""
    p = (counts + BACKOFF * weights / weights.sum()) / (counts.sum(1, keepdims=True) + BACKOFF)
    return np.log10(np.divide(p, weights, out=np.ones(p.shape), where=weights > 0))


# ---- (5) scores


def lm_score(docs: DataFrame, hold_out: tuple[int, int] = (10, 0), classes: int = CLASSES, core_share: int = CORE, listed_share: int = LISTED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    small_batches(docs.sparkSession)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", hold_out[0]) == hold_out[1]).alias("held_out"), F.col("text").cast("string").alias("text"))
    train = every.where("not held_out").select("text")
    parts = parts_for(docs, PART_BYTES)
    words = cut(vocabulary(train, parts))
    sums = words.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first()
    texts = train.count()
    n_train, distinct = (sums["tokens"] or 0) + texts, (sums["words"] or 0) + (texts > 0)
    core = Words(*frequent(words, max(1, n_train / core_share)))
    bigrams = bigram_counts(train, core)
    cls = exchange(bigrams, len(core.h), classes)
    core.cls = cls[: len(core.h)]
    words = cut(classed(train, words, core, cls, bigrams, parts))
    model = Model(Words(*frequent(words, max(1, n_train / listed_share))), int(cls.max()))
    gain = transition_logs(history_counts(train, words, model, parts), class_weights(words, texts, model.classes))
    scored = _scored(every, words, model, gain, texts, parts)
    base = F.col("log") - F.col("n_tokens") * log10(n_train + SMOOTH * (distinct + 1))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("log") + F.col("gain")).alias("score"))


PACKED = ["part", "batch", "a", "b", "c", "d", "e", "f", "g"]
PACKED_SCHEMA = "part long, batch long, " + ", ".join(f"{c} binary" for c in PACKED[2:])


def _scored(every: DataFrame, words: DataFrame, model: Model, gain: np.ndarray, texts: int, parts: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, log (sum of the tokens' smoothed counts' logarithms), gain (sum of transition logs)."""
    listed_log = np.log10(model.listed.count + SMOOTH)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with what is known of each text (of a negative part of its own), and rows with its other words by part; flushed now and then."""
        task, flushes = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n", "known", "log", "gain", "h", "form", "history", "doc")}
        there = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal flushes, there, size
            if not there:
                return
            group = task << 24 | flushes
            ids = pa.chunked_array(held["doc_id"]).combine_chunks()
            known = {k: np.concatenate(held[k]) for k in ("held_out", "n", "known", "log", "gain")}
            blob = [pc.fill_null(ids, 0).to_numpy().astype(np.int64).tobytes(), pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), *(known[k].tobytes() for k in known)]
            rows = [(-1 - group, *blob)]
            h, form, history, doc = (np.concatenate(held[k]) for k in ("h", "form", "history", "doc"))
            for p, at in by_part(h, parts):
                own, first, n = np.unique(h[at], return_index=True, return_counts=True)
                rows.append((p, own.tobytes(), n.astype(np.uint32).tobytes(), history[at].tobytes(), doc[at].astype(np.int32).tobytes(), form[at[first]].tobytes(), b"", b""))
            flushes += 1
            there = size = 0
            for v in held.values():
                v.clear()
            for k in range(0, len(rows), 64):
                some = list(zip(*rows[k : k + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int64()), pa.array([group] * len(some[0]), pa.int64()), *(pa.array(x, pa.binary()) for x in some[1:])], names=PACKED)

        for batch in batches:
            for i, j, data, offsets in T.slices(T.text_column(batch)):
                h, form, at, known, history, ends, place = model.read(data, offsets)
                log, gained, seen = (np.zeros(ends[-1]) for _ in range(3))
                log[ends[1:] - 1], gained[ends[1:] - 1], seen[ends[1:] - 1] = log10(texts + SMOOTH), gain[history[ends[1:] - 1], model.end], texts > 0
                some = place[known]
                if len(some):
                    log[some], gained[some], seen[some] = listed_log[at[known]], gain[history[some], model.listed.cls[at[known]]], 1
                held["doc_id"].append(batch.column(0).slice(i, j - i))
                held["held_out"].append(np.asarray(batch.column(1).slice(i, j - i).to_pylist(), np.uint8))
                held["n"].append(np.diff(ends))
                held["known"].append(T.total_by(seen, ends).astype(np.int64))
                held["log"].append(T.total_by(log, ends))
                held["gain"].append(T.total_by(gained, ends))
                held["h"].append(h[~known])
                held["form"].append(form[~known].astype(np.uint8))
                held["history"].append(history[place[~known]].astype(np.uint8))
                held["doc"].append(T.owner(ends)[place[~known]] + there)
                there += j - i
                size += len(h)
                if size >= FLUSH:
                    yield from flush()
        yield from flush()

    def tally(key: tuple, rows: pa.Table, own: pa.Table) -> pa.Table:
        """Sums by text of the words of a part."""
        if key[0].as_py() < 0:
            return rows
        h, n, cls = (np.frombuffer(own[c][0].as_py(), t) if own.num_rows else np.empty(0, t) for c, t in (("h", np.uint64), ("n", np.int64), ("cls", np.uint8)))
        vocabulary_ = Words(h, n, cls)
        out = []
        if not rows.num_rows:
            return rows
        for batch, *x in zip(*(rows[c].to_pylist() for c in ("batch", "a", "b", "c", "d", "e")), strict=True):
            own_h, times, history, doc, form = (np.frombuffer(v, t) for v, t in zip(x, (np.uint64, np.uint32, np.uint8, np.int32, np.uint8), strict=True))
            at, known = vocabulary_.find(own_h)
            count, c = np.zeros(len(at), np.int64), model.classes - FORMS + form.astype(np.int64)
            count[known], c[known] = vocabulary_.count[at[known]], vocabulary_.cls[at[known]]
            count, c = np.repeat(count, times), np.repeat(c, times)
            order = np.argsort(doc, kind="stable")
            texts_, first = np.unique(doc[order], return_index=True)
            sums = [np.add.reduceat(v[order], first) for v in (np.log10(count + SMOOTH), gain[history, c], (count > 0).astype(np.int64))]
            out.append((key[0].as_py(), batch, texts_.tobytes(), sums[0].tobytes(), sums[1].tobytes(), sums[2].astype(np.int32).tobytes(), b"", b"", b""))
        columns = list(zip(*out, strict=True))
        return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:2]), *(pa.array(c, pa.binary()) for c in columns[2:])], names=PACKED)

    def join(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All of a packed group's texts."""
        base, sums = None, []
        for batch in rows:
            for r in batch.to_pylist():
                if r["part"] < 0:
                    base = r
                else:
                    sums.append([np.frombuffer(r[k], t) for k, t in (("a", np.int32), ("b", np.float64), ("c", np.float64), ("d", np.int32))])
        ids, valid, out, n, known, log, gained = (np.frombuffer(base[k], t).copy() for k, t in zip("abcdefg", (np.int64, np.uint8, np.uint8, np.int64, np.int64, np.float64, np.float64), strict=True))
        for at, more_log, more_gain, more_known in sorted(sums, key=lambda x: (x[0].tobytes(), x[1].tobytes())):  # one order of addition
            log[at] += more_log
            gained[at] += more_gain
            known[at] += more_known
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), pa.array(out.astype(bool)), pa.array(n), pa.array(known), pa.array(log), pa.array(gained)], names=["doc_id", "held_out", "n_tokens", "n_known", "log", "gain"])

    packed = every.select("doc_id", "held_out", "text").mapInArrow(pack, PACKED_SCHEMA)
    tallied = packed.groupBy("part").cogroup(words.groupBy("part")).applyInArrow(tally, PACKED_SCHEMA)
    return tallied.groupBy("batch").applyInArrow(join, "doc_id long, held_out boolean, n_tokens long, n_known long, log double, gain double")
