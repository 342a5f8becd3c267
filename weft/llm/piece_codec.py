"""SentencePiece encoding and decoding under the max-plus semiring.

An encoding is the sequence of pieces of the largest total score; scores are whole numbers, and of equal paths the one is taken that,
from the end, has the longest piece each time. No piece spans the place before a space that follows a character, nor a line break, so
these places cut a text into words that are encoded on their own, by the library, whose rule is the same, as long as its sums in
single precision are exact, and looked up when they come again.

A text over ``giant`` characters is cut into chunks at fixed distances, in whatever words they fall; a boundary's state is how many
characters the piece across it reaches into the next chunk. (1) A chunk yields the matrix of best weights from each state at its
start to each state at its end. (2) Matrices combine associatively (max, +): products of runs of chunks, then of the runs before
each, then within each run, give the weights of all states at every boundary. (3) From these, each chunk yields the state at its
start that leads to each state at its end; such maps combine associatively too, from the end, which gives the state at every
boundary. (4) Each chunk is traced back on its own. All four are passes over chunks in parallel; only the runs of a text, one for
RUN chunks, meet in a task. The ids are those of the whole text for any size of chunk, and so for any ``giant``.

Text is encoded losslessly: a space is written as U+2581 after one is put in front, a U+2581 in the text itself goes byte by
byte, and so does a character without a piece. Decoding gives the text back exactly. The vocabulary is read once by the
driver from ``model_path`` and is of a fixed size.

Defined results: a null text has null ids, an empty one none; repeated rows agree; of other columns only those named in ``keep`` are
read, and given back beside the ids.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.llm.common import cut, small_batches

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters beyond which a text is cut up, and of its chunks; chunks that are combined in one run.
GIANT, CHUNK, RUN = 100_000, 25_000, 64
MARK = "▁"
#: What a U+2581 of the text is written as: a private character that no vocabulary has, at the end of the last plane.
ESCAPE = "\U0010fffd"
OUT = "\U0010fffe"
#: Below the weight of any path.
NONE = -(1 << 62)
#: Pieces with so low a score have no rank of their own; they come after all others.
UNRANKED = -1e8
#: Words whose ids a worker keeps, and characters of the longest that it does, and that the library's sums are exact for.
KEPT, LONG_WORD = 300_000, 100
#: Bytes that are decoded at once.
SLICE = 1 << 20


def unigram_model(model: bytes) -> bytes:
    """The same pieces and scores, as a model whose encoding is the best path, with normalisation off."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto.FromString(model)
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    plain = pb.ModelProto.SentencePiece.NORMAL
    lowest = min(p.score for p in m.pieces if p.type == plain and p.score > UNRANKED)
    for p in m.pieces:
        if p.type == plain and p.score <= UNRANKED:
            p.score = lowest - 1
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.precompiled_charsmap = b""
    m.normalizer_spec.add_dummy_prefix = False
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.escape_whitespaces = False
    return m.SerializeToString()


class Codec:
    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_proto=unigram_model(model))
        size = sp.get_piece_size()
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.weight = {sp.id_to_piece(i): round(sp.get_score(i)) for i in plain}
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.unknown = min(self.weight.values()) - 10  # as the library has it
        self.longest = max(map(len, self.weight))
        if any(re.search(f"[^{MARK}]{MARK}", p) or len(p) > 1 and "\n" in p for p in self.weight):
            raise ValueError("a piece spans words")
        spelt = [b""] * size
        for i in plain:
            spelt[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
        for b, i in self.byte_id.items():
            spelt[i] = bytes([b])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.length = np.array([len(x) for x in spelt])
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.kept: dict[str, bytes] = {}
        self.marked: dict[str, bytes] = {}

    @staticmethod
    def write(text: str) -> str:
        """The text as pieces spell it."""
        return " ".join(("", text)).replace(ESCAPE, ESCAPE + OUT).replace(MARK, ESCAPE + ESCAPE).replace(" ", MARK)

    # ---- whole texts, word by word

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit numbers."""
        if not text:
            return b""
        if "  " not in text and text[0] != " " and MARK not in text and ESCAPE not in text:
            words, known, mark = text.replace("\n", " \n").split(" "), self.marked, True
        else:
            words, known, mark = re.findall(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|^[^{MARK}\n]+", self.write(text)), self.kept, False
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > KEPT:
                known.clear()
            new = [w for w in set(words) if w not in known]
            spelt = [MARK + w if mark and w[:1] != "\n" else w for w in new]
            usual = [k for k, w in enumerate(spelt) if len(w) <= LONG_WORD]
            for k, ids in zip(usual, self.sp.encode([spelt[k] for k in usual], num_threads=1), strict=True):
                known[new[k]] = array("i", ids).tobytes()
            if len(usual) == len(new):
                return b"".join(map(known.__getitem__, words))
            long = {w: array("i", self.path(s)).tobytes() for w, s in zip(new, spelt, strict=True) if len(s) > LONG_WORD}
            return b"".join([long[w] if w in long else known[w] for w in words])

    def path(self, s: str) -> list[int]:
        _, back = self.lattice(s, len(s), [0])
        return self.trace(s, back, len(s))[0]

    # ---- a lattice over a chunk

    def lattice(self, s: str, body: int, entry: list[int]) -> tuple[list[int], list[int]]:
        """Over s, whose first ``body`` characters are the chunk's (s goes on as far as a last piece may reach): the best weight
        at each place, from the weights ``entry`` of the first places; and where the last piece to it starts, -1 if before s."""
        best, back = [NONE] * (len(s) + 1), [-1] * (len(s) + 1)
        best[: len(entry)] = entry[: len(best)]
        get, longest, unknown, size = self.weight.get, self.longest, self.unknown, len(s)
        for i in range(body):
            v = best[i]
            if v == NONE:
                continue
            if s[i] not in self.weight and v + unknown > best[i + 1]:
                best[i + 1], back[i + 1] = v + unknown, i
            for j in range(i + 1, min(size, i + longest) + 1):
                w = get(s[i:j])
                if w is not None and v + w > best[j]:
                    best[j], back[j] = v + w, i
        return best, back

    def trace(self, s: str, back: list[int], end: int) -> tuple[list[int], int]:
        """Ids of the pieces that start in s and lead to ``end``; and the place at which they begin."""
        out: list[int] = []
        while back[end] >= 0:
            p = s[back[end] : end]
            out.extend([self.id[p]] if p in self.id else [self.byte_id[b] for b in reversed(p.encode("utf-8", "surrogatepass"))])
            end = back[end]
        return out[::-1], end

    def matrix(self, s: str, body: int) -> np.ndarray:
        """Best weights by (state at the start, state at the end)."""
        states = self.longest
        out = np.full((states, states), NONE, np.int64)
        place = self.meeting(s, body)
        if place < 0:
            for a in range(states):
                best, _ = self.lattice(s, body, [NONE] * a + [0]) if a <= body else ([], [])
                for e, v in enumerate(best[body : body + states]):
                    out[a, e] = v
        else:  # all paths go through the place
            head = [self.lattice(s[: place + 1], place, [NONE] * a + [0])[0][place] for a in range(states)]
            best, _ = self.lattice(s[place:], body - place, [0])
            tail = np.array((best[body - place :] + [NONE] * states)[:states])
            for a, h in enumerate(head):
                if h != NONE:
                    out[a] = np.where(tail == NONE, NONE, tail + h)
        for a in range(body + 1, states):  # a piece may reach over a whole short chunk
            out[a, a - body] = 0
        return out

    def meeting(self, s: str, body: int) -> int:
        """The first place of the chunk beyond all states that no piece spans; -1 if there is none."""
        at = re.compile(f"[^{MARK}]{MARK}|.\n", re.DOTALL).search(s, self.longest, max(self.longest, body))
        return at.start() + 1 if at and at.start() + 1 < body else -1

    def map_back(self, s: str, body: int, entry: np.ndarray) -> np.ndarray:
        """The state at the start that the best path to each state at the end comes from, -1 where there is none."""
        best, back = self.lattice(s, body, entry.tolist())
        root = list(range(len(back)))
        for j, i in enumerate(back):
            if i >= 0:
                root[j] = root[i]
        out = np.full(self.longest, -1, np.int64)
        for e in range(min(self.longest, len(best) - body)):
            if best[body + e] != NONE:
                out[e] = root[body + e]
        return out

    def chunk_ids(self, s: str, body: int, entry: np.ndarray, state: int) -> list[int]:
        """Ids of the pieces that start in the chunk, on the best path to the state at its end."""
        _, back = self.lattice(s, body, entry.tolist())
        return self.trace(s, back, body + state)[0]

    # ---- decoding

    def decode_all(self, ids: list[bytes | None]) -> Iterator[bytes | None]:
        """The texts' UTF-8 bytes."""
        k = 0
        while k < len(ids):
            n, size = k, 0
            while n < len(ids) and (n == k or size < SLICE):
                size += len(ids[n] or b"")
                n += 1
            each = [x or b"" for x in ids[k:n]]
            every = np.frombuffer(b"".join(each), "<i4")
            length = self.length[every]
            ends = np.concatenate([[0], np.cumsum(length)])
            data = self.spelt[np.arange(ends[-1]) + np.repeat(self.start[every] - ends[:-1], length)].tobytes()
            at = 0
            for given, x in zip(ids[k:n], each, strict=True):
                text = data[ends[at] : ends[at + len(x) // 4]]
                at += len(x) // 4
                if ESCAPE.encode() in text:
                    text = text.replace((ESCAPE + ESCAPE).encode(), MARK.encode()).replace((ESCAPE + OUT).encode(), ESCAPE.encode())
                yield None if given is None else text[1:]
            k = n

    def decode(self, ids: list[int]) -> str:
        return next(self.decode_all([np.array(ids, "<i4").tobytes()])).decode("utf-8", "surrogatepass")


# ---- the scan over chunks


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    out = np.full((len(a), b.shape[1]), NONE, np.int64)
    for k in range(b.shape[0]):
        np.maximum(out, np.where((a[:, k : k + 1] == NONE) | (b[k : k + 1] == NONE), NONE, a[:, k : k + 1] + b[k : k + 1]), out=out)
    return out


def compose(later: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The map through both, the later one first; -1 for none."""
    return np.where(later >= 0, before[np.maximum(later, 0)], -1)


class Matrices:
    """Elements are matrices, states are row vectors of weights."""

    def __init__(self, side: int) -> None:
        self.side = side

    def read(self, x: bytes) -> np.ndarray:
        return np.frombuffer(x, np.int64).reshape(-1, self.side)

    def first(self) -> np.ndarray:
        return np.where(np.arange(self.side) == 0, 0, NONE).astype(np.int64)[None, :]

    join = staticmethod(combine)


class Maps:
    """Elements are maps, in order from the end; states are the places that state 0 at the end comes from."""

    def __init__(self, side: int) -> None:
        self.side = side

    def read(self, x: bytes) -> np.ndarray:
        return np.frombuffer(x, np.int64)

    def first(self) -> np.ndarray:
        return np.array([0], np.int64)

    join = staticmethod(compose)


def prefixes(elements: DataFrame, kind: Matrices | Maps) -> DataFrame:
    """elements: text, k, x. text, k, state: what the elements of smaller k make of the first state. Runs of elements are
    combined, then the runs before each run, then the elements before each within a run."""
    placed = elements.withColumn("run", F.floor(F.col("k") / RUN))

    def sorted_rows(rows: pa.Table, order: str) -> list[tuple[int, np.ndarray]]:
        return [(k, kind.read(x)) for k, x in sorted(zip(rows[order].to_pylist(), rows["x"].to_pylist(), strict=True))]

    def product(key: tuple, rows: pa.Table) -> pa.Table:
        out = None
        for _, x in sorted_rows(rows, "k"):
            out = x if out is None else kind.join(out, x)
        return pa.table({"text": [key[0].as_py()], "run": [key[1].as_py()], "x": [out.astype(np.int64).tobytes()]}, schema=pa.schema([("text", pa.int64()), ("run", pa.int64()), ("x", pa.binary())]))

    def states(text: int, names: str, got: list[tuple[int, np.ndarray]], state: np.ndarray) -> pa.Table:
        out = []
        for _, x in got:
            out.append(state.astype(np.int64).tobytes())
            state = kind.join(state, x)
        return pa.table({"text": [text] * len(got), names: [k for k, _ in got], "state": out}, schema=pa.schema([("text", pa.int64()), (names, pa.int64()), ("state", pa.binary())]))

    def runs(key: tuple, rows: pa.Table) -> pa.Table:
        return states(key[0].as_py(), "run", sorted_rows(rows, "run"), kind.first())

    def within(key: tuple, rows: pa.Table, before: pa.Table) -> pa.Table:
        return states(key[0].as_py(), "k", sorted_rows(rows, "k"), kind.read(before["state"][0].as_py()))

    before = placed.groupBy("text", "run").applyInArrow(product, "text long, run long, x binary").groupBy("text").applyInArrow(runs, "text long, run long, state binary")
    return placed.groupBy("text", "run").cogroup(before.groupBy("text", "run")).applyInArrow(within, "text long, k long, state binary")


@cache
def _codec(model: bytes) -> Codec:
    return Codec(model)


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _ids_columns(codec: Codec, ids: list[bytes | None]) -> list[pa.Array]:
    offsets = np.concatenate([[0], np.cumsum([len(i or b"") // 4 for i in ids])]).astype(np.int32)
    values = np.frombuffer(b"".join(i for i in ids if i), "<i4")
    return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([i is None for i in ids], pa.bool_()))]


def _digest_columns(codec: Codec, ids: list[bytes | None]) -> list[pa.Array]:
    n = [None if i is None else len(i) // 4 for i in ids]
    crc = [None if i is None else zlib.crc32(i) for i in ids]
    return [pa.array(x, pa.int64()) for x in (n, crc, [None if t is None else zlib.crc32(t) for t in codec.decode_all(ids)])]


#: What becomes of the ids: its columns' schema, names and builder.
IDS = ("ids array<int>", ["ids"], _ids_columns)
DIGEST = ("n_tokens long, ids_crc32 long, decoded_crc32 long", ["n_tokens", "ids_crc32", "decoded_crc32"], _digest_columns)


def encode(docs: DataFrame, model_path: str = MODEL_PATH, giant: int = GIANT, chunk: int = CHUNK, give: tuple = IDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in ``keep``, and ids (array of int) of every document; with DIGEST, instead of ids: their number,
    the CRC-32 of them as little-endian 32-bit numbers, and that of the text they decode to."""
    small_batches(docs.sparkSession)
    model = read_model(model_path)
    schema, names, columns = give
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("string").alias("text"))
    out_schema = StructType([*every.schema.fields[:-1], *StructType.fromDDL(schema).fields])
    is_giant = F.coalesce(F.length("text"), F.lit(0)) > giant

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                some = batch.slice(k, 128)
                ids = [None if t is None else codec.encode(t) for t in some.column(some.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *columns(codec, ids)], names=[*batch.schema.names[:-1], *names])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], *columns(codec, row.column(row.num_columns - 1).to_pylist())], names=[*batch.schema.names[:-1], *names])

    # the giants are few, or the corpus consists of them; identical ones are worked on once
    giants = cut(every.where(is_giant).withColumn("weft_text", F.xxhash64("text", F.length("text"))))
    whole = _scanned(giants.select(F.col("weft_text").alias("text_id"), "text"), model, chunk)
    ended = giants.drop("text").join(whole.withColumnRenamed("text_id", "weft_text"), "weft_text").select(*every.columns[:-1], "ids")
    return every.where(~is_giant).mapInArrow(short, out_schema).union(ended.mapInArrow(finish, out_schema))


def _scanned(giants: DataFrame, model: bytes, chunk: int) -> DataFrame:
    """text_id, ids (32-bit numbers) of each distinct text."""
    side = _codec(model).longest

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = Codec.write(text)
                for k, i in enumerate(range(0, len(s), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([text_id], pa.int64()), pa.array([k]), pa.array([min(chunk, len(s) - i)]), pa.array([s[i : i + chunk + side - 1]], pa.string())], names=["text", "k", "body", "s"])

    def each(of: Callable[..., tuple]) -> Callable:
        """An element or a list of ids of every chunk."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(model)
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    k, x = of(codec, *row[1:])
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([k], pa.int64()), pa.array([np.asarray(x).tobytes()], pa.binary())], names=["text", "k", "x"])

        return run

    made = "text long, k long, x binary"
    texts = giants.groupBy("text_id").agg(F.first("text").alias("text"))
    chunks = cut(texts.mapInArrow(cut_up, "text long, k long, body long, s string").repartition("text", "k"))
    entries = cut(prefixes(chunks.mapInArrow(each(lambda codec, k, body, s: (k, codec.matrix(s, body))), made), Matrices(side)))
    entered = chunks.join(entries, ["text", "k"])
    maps = entered.mapInArrow(each(lambda codec, k, body, s, v: (-k, codec.map_back(s, body, np.frombuffer(v, np.int64)))), made)
    exits = prefixes(maps, Maps(side)).select("text", (-F.col("k")).alias("k"), F.col("state").alias("end"))
    traced = entered.join(exits, ["text", "k"]).mapInArrow(each(lambda codec, k, body, s, v, e: (k, np.array(codec.chunk_ids(s, body, np.frombuffer(v, np.int64), int(np.frombuffer(e, np.int64)[0])), "<i4"))), made)

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        ids = b"".join(x for _, x in sorted(zip(rows["k"].to_pylist(), rows["x"].to_pylist(), strict=True)))
        return pa.table({"text_id": [key[0].as_py()], "ids": [ids]}, schema=pa.schema([("text_id", pa.int64()), ("ids", pa.binary())]))

    return traced.groupBy("text").applyInArrow(joined, "text_id long, ids binary")


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, text of every row of doc_id, ids."""
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            ids = [None if i is None else np.array(i, "<i4").tobytes() for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else t.decode("utf-8", "surrogatepass") for t in codec.decode_all(ids)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
