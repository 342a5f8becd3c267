"""Operators against brute force, round trips and defined results on small tables."""

import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import brown_lm, jaccard_join, language_id, maxscore, mixing, passages, piece_codec, quality_classifier, quality_rules, sharding
from weft.llm import textops as T
from weft.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table():
    """Nulls, empty and long texts, copies, near copies, ties, repeated rows; extra columns with clashing names."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (3, 4, 5, 6, 9, 12, 20, 40, 80, 150, 300)]
    for t in list(texts[3:]):
        w = t.split()
        for share in (0.01, 0.03, 0.06, 0.1):
            texts.append(" ".join(r.choice(words) if r.random() < share else x for x in w))
        texts.append(t.upper())
    passage = " ".join(r.choice(words) for _ in range(70))
    texts += [" ".join([*(r.choice(words) for _ in range(60)), passage, *(r.choice(words) for _ in range(30))]) for _ in range(3)]
    texts += [None, "", " \n ", "x", "▁ a▁", "éè 漢字", "same " * 400, "word " * 20000]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s0", "s0", "s1", None)[i % 4], 0, "clash", -1) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id here at all, is there", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")


def test_words_and_hashes():
    texts = ["a b", "", None, "b  a\n", "ab"]
    for _, _, data, offsets in T.slices(pa.array(texts)):
        starts, ends, bounds = T.words(data, offsets)
        h = T.range_hash(data, starts, ends)
        assert list(np.diff(bounds)) == [2, 0, 0, 2, 1] and h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3


def test_mix(spark, docs, empty):
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count()
    sizes = Counter()
    for row in table():
        sizes[row[3]] += len(WORD.findall(row[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    targets, open_, left = {}, set(names), float(sum(sizes.values()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in over or open_:
            targets[s] = min(3.0 * sizes[s], level * weight[s])
        open_ -= over or set(open_)
        left -= sum(targets[s] for s in over)
    for s in names:
        own = got[got.source.isnull()] if s is None else got[got.source == s]
        assert abs(own.target.iloc[0] - targets[s]) < 1e-6 and abs(own.taken.sum() - targets[s]) <= 1 and own.source_size.iloc[0] == sizes[s]
    assert (got.taken <= 3 * got["size"]).all() and mixing.mix(empty).count() == 0


def test_schedules_invert():
    for knots in mixing.SCHEDULES:
        parts = mixing.segments(knots)
        ends = [a for _, _, _, a in parts[1:]] + [1.0]
        for (t, m, s, a), (end, z) in zip(parts, zip([p[0] for p in parts[1:]] + [1.0], ends)):
            assert abs(a + m * (end - t) + s * (end - t) ** 2 / 2 - z) < 1e-9


def test_hilbert(spark, docs, empty):
    from pyspark.sql import functions as F

    grid = spark.range(512).select(*((F.floor(F.col("id") / 8**k) % 8).cast("int").alias(c) for k, c in enumerate("xyz")))
    at = {r.h: (r.x, r.y, r.z) for r in grid.select("x", "y", "z", sharding.hilbert_index([F.col(c) for c in "xyz"], 3).alias("h")).collect()}
    assert sorted(at) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(511))
    got = sharding.hilbert_shards(docs).toPandas()
    counts = got.groupby("shard").slot.agg(["size", "min", "max", "nunique"])
    assert len(got) == docs.count() and counts["size"].max() - counts["size"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] == counts["size"] - 1).all() and (counts["nunique"] == counts["size"]).all()
    text = {r[0]: r[1] for r in table()}
    for r in got[got.text_crc32.notnull() & got.doc_id.notnull()].itertuples():
        assert r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 8
    assert sharding.hilbert_shards(empty).count() == 0


def _curve(dims, bits):
    """A plain walk down the levels of the same curve: corners in Gray order, entry and direction of each part by the usual recurrences."""
    n = len(dims)
    full = (1 << n) - 1
    turn_left = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & full
    turn_right = lambda x, k: turn_left(x, n - k % n)
    gray = lambda x: x ^ x >> 1
    index, entry, turn = 0, 0, 0
    for i in reversed(range(bits)):
        corner = sum((d >> i & 1) << k for k, d in enumerate(dims))
        seen = turn_right(corner ^ entry, turn + 1)
        w = next(x for x in range(1 << n) if gray(x) == seen)
        index = index << n | w
        entry ^= turn_left(0 if w == 0 else gray(2 * ((w - 1) // 2)), turn + 1)
        ones = lambda x: (x ^ (x + 1)).bit_length() - 1
        turn = (turn + (0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n) + 1) % n
    return index


def test_shards_follow_the_curve_and_prune(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.hilbert_shards(d).join(d.select("doc_id", "lang", "source"), "doc_id").toPandas()
    last = (1 << sharding.BITS) - 1
    cell = {}
    for c in ("lang", "source"):
        values = sorted(v for v in got[c].unique() if v is not None)
        cell[c] = {v: k * last // len(values) for k, v in enumerate(values)} | {None: last}
    for r in got.itertuples():
        size = min(last, max(0, int(np.floor(2 * np.log2(r.size / 8)))))
        assert r.curve_index == _curve([cell["lang"][r.lang], cell["source"][r.source], size], sharding.BITS)
    order = got.sort_values(["shard", "slot"])
    assert order.curve_index.is_monotonic_increasing and (order["shard"].values == np.arange(len(got)) * 24 // len(got)).all()
    held = got.groupby(["lang", "source"], dropna=False)["shard"].nunique()  # shards that a filter on both has to read
    assert (held * got.groupby(["lang", "source"], dropna=False).size()).sum() / len(got) < 24 / 3


def test_jaccard_components(docs, empty):
    sets = {}
    for row in table():
        w = WORD.findall((row[1] or "").translate(LOWER))
        sets[row[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted((i for i in sets if i is not None))
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    got = jaccard_join.jaccard_components(docs).toPandas()
    assert len(got) == docs.count()
    for r in got[got.doc_id.notnull()].itertuples():
        assert r.n_shingles == len(sets[r.doc_id]) and r.component_id == find(r.doc_id)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_null_ids_lose_no_document(spark):
    r = random.Random(17)
    a, b, c, d = (_words(r, 60) for _ in range(4))
    near = [[*x[:-1], "changed"] for x in (a, b)]
    rows = [(None, a), (5, a), (3, near[0]), (None, b), (None, near[1]), (None, c), (None, c), (8, d), (None, None), (None, [])]
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w), k) for k, (i, w) in enumerate(rows)], "doc_id long, text string, row int")
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted(((x.doc_id, x.component_id) for x in got if x.component_id is not None), key=str) == [(3, 3), (5, 3), (8, 8), (None, 3)] and len(got) == 10
    kept = {x.row for x in jaccard_join.one_of_each(docs).collect()}
    assert kept >= {2, 7, 8, 9} and len(kept & {3, 4}) == 1 and len(kept & {5, 6}) == 1 and len(kept) == 6


def test_links_of_a_large_group_of_near_copies(spark, monkeypatch):
    r = random.Random(31)
    words = [f"w{i}" for i in range(500)]
    base = [r.choice(words) for _ in range(90)]
    rows = [(k, " ".join(r.choice(words) if r.random() < share else w for w in base)) for k in range(300) for share in [r.choice((0.0, 0.01, 0.03, 0.05, 0.08))]]
    rows += [(1000 + k, f"a passage that {k} many share " + " ".join(base[20:32]) + f" and more of {k} its own {k * 7} here") for k in range(60)]
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    assert 20 < len({find(i) for i in sets}) < 350
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for blocks in ((1 << 30, 1 << 30, 1), (200, 3000, 4)):  # a group within a block, and over several
        monkeypatch.setattr(jaccard_join, "BITMAP_BLOCKS", blocks)
        monkeypatch.setattr(jaccard_join, "SET_BLOCKS", blocks)
        assert {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(docs).collect()} == {i: find(i) for i in sets}


def test_components(spark):
    r = random.Random(37)
    for pairs in ([(k, k + 1) for k in range(60)], [(r.randrange(300), r.randrange(300)) for _ in range(200)], [(5, 5)], []):
        top = {x: x for p in pairs for x in p}

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
        got = {x.node: x.label for x in components(spark.createDataFrame(pairs, "u long, v long"), 300).collect()}
        assert got == {x: find(x) for x in top if any(a != b and x in (a, b) for a, b in pairs)}


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 8, 13, 31, 64, 200, 700])
def test_every_similar_pair_shares_a_key(size):
    r = np.random.default_rng(size)
    for _ in range(30):
        base = r.integers(0, 1 << 63, size, dtype=np.uint64)
        drop = r.integers(0, max(1, size // 7) + 1)
        add = r.integers(0, max(1, size // 7) + 1)
        a, b = np.unique(base), np.unique(np.concatenate([base[drop:], r.integers(0, 1 << 63, add, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
            assert len(np.intersect1d(jaccard_join.keys(a), jaccard_join.keys(b)))
            levels = np.random.default_rng(1).integers(0, 9, 1 << jaccard_join.SLOT_BITS).astype(np.uint8)
            assert len(np.intersect1d(jaccard_join.keys(a, levels=levels), jaccard_join.keys(b, levels=levels)))
            x, y = jaccard_join.bitmap(a), jaccard_join.bitmap(b)
            width = min(len(x), len(y))
            differ = int(np.bitwise_count(jaccard_join.folded(x, width) ^ jaccard_join.folded(y, width)).sum())
            assert differ <= len(np.setxor1d(a, b))


def test_passages(docs, empty):
    got = passages.passages(docs).toPandas()
    rows = [(r[0], r[1]) for r in table()]
    planted = [i for i, t in rows if i is not None and t and len(t.split()) == 160]
    found = {(r.doc_id, r.other_doc_id) for r in got.itertuples()}
    assert {(planted[1], planted[0]), (planted[2], planted[0])} <= found
    for r in got[got.doc_id == planted[1]].itertuples():
        if r.other_doc_id == planted[0]:
            assert abs(r.start_word - 60) <= 2 and abs(r.end_word - 130) <= 2
    rest = {r.doc_id: r.text for r in passages.without_repeats(docs).collect()}
    assert len(rest[planted[1]].split()) <= 94 and rest[planted[0]] == dict(rows)[planted[0]] and rest[8] == dict(rows)[8]
    assert passages.passages(empty).count() == 0


def _words(r, n):
    return ["".join(r.choice("abcdefghijkl") for _ in range(7)) for _ in range(n)]


def test_short_shared_lines_are_no_passage(spark):
    r = random.Random(11)
    lines = [_words(r, 15) for _ in range(3)]
    lone = [w for line in lines for w in (*_words(r, 12), *line)] + _words(r, 12)
    long = _words(r, 60)
    rows = [(k, " ".join([*_words(r, 30), *line, *_words(r, 30)])) for k, line in enumerate(lines)] + [(3, " ".join([*_words(r, 30), *long]))]
    mixed = [w for line in lines for w in (*_words(r, 12), *line)] + _words(r, 12)
    rows += [(10, " ".join(lone)), (11, " ".join([*mixed, *long]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.passages(docs).toPandas()
    assert 10 not in set(found.doc_id) and set(found[found.doc_id == 11].other_doc_id) == {3}
    rest = {x.doc_id: x.text.split() for x in passages.without_repeats(docs).collect()}
    assert rest[10] == lone and rest[11] == mixed[:39]  # 90 of the other 114 words are elsewhere, of 141 with one more line 105


def test_every_copy_of_a_passage_is_found(spark):
    r = random.Random(13)
    long, half = _words(r, 60), _words(r, 60)
    rest = [_words(r, 80) for _ in range(6)]
    rows = [(0, [*rest[0], *long]), (1, [*rest[1], *half]), (10, [*rest[2], *long, *rest[3], *long]), (11, [*rest[4], *half[:30], *rest[5], *half])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {x.doc_id: x.text.split() for x in passages.without_repeats(docs).collect()}
    assert got[0] == rows[0][1] and got[10] == [*rest[2], *rest[3]] and got[11] == [*rest[4], *half[:30], *rest[5]]


def test_united_parts_agree():
    r = np.random.default_rng(2)
    for _ in range(300):
        start = np.sort(r.integers(0, 300, 8))
        end = start + r.integers(6, 70, 8)
        same = [r.random(e - s) < 0.95 for s, e in zip(start, end)]
        matched = np.zeros(400, bool)
        for s, e, x in zip(start, end, same):
            matched[s:e] |= x
        for s, e, x, span in zip(start, end, same, passages.united(start, end, same, 50, 0.75)):
            assert span or e - s < 50 or x.mean() < 0.75
            if span:
                assert span[0] <= s and e <= span[1] and span[1] - span[0] >= 50 and matched[span[0] : span[1]].mean() >= 0.75


def test_passages_of_ids_that_repeat_or_are_null(spark):
    r = random.Random(29)
    long = _words(r, 60)
    rest = [_words(r, 40) for _ in range(5)]
    rows = [(7, rest[0]), (7, [*rest[1], *long]), (3, [*long, *rest[2]]), (None, [*rest[3], *long]), (None, [*rest[4], *long]), (7, [*rest[1], *long]), (8, None), (9, [])]
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w), k, "x") for k, (i, w) in enumerate(rows)], "doc_id long, text string, n_chars long, ids string")
    got = passages.without_repeats(docs.withColumnRenamed("n_chars", "row")).collect()
    left = {x.row: x.text.split() if x.text is not None else None for x in got}
    assert left == {0: rest[0], 1: rest[1], 2: rows[2][1], 3: rest[3], 4: rest[4], 5: rest[1], 6: None, 7: []} and all(x.ids == "x" for x in got)
    found = passages.passages(docs).collect()
    assert sorted(x.doc_id or -1 for x in found) == [-1, -1, 7] and all(x.other_doc_id in (3, 7) for x in found)


def test_chain_scores_are_the_best():
    r = np.random.default_rng(5)
    K, W, C = passages.K, passages.WIDEST_GAP, passages.GAP_COST
    for _ in range(200):
        n = int(r.integers(2, 25))
        start = r.integers(0, 120, n)
        runs = np.stack([start, start + r.integers(K, 30, n), r.integers(0, 150, n)], axis=1)
        runs = np.unique(runs, axis=0)[np.lexsort((np.unique(runs, axis=0)[:, 2], np.unique(runs, axis=0)[:, 0]))]
        best = (runs[:, 1] - runs[:, 0]).astype(float)
        end, other, other_end = runs[:, 1], runs[:, 2], runs[:, 2] + runs[:, 1] - runs[:, 0]
        for i in range(len(runs)):
            for j in range(i):
                x, y = runs[i, 0] - end[j], other[i] - other_end[j]
                if -K < x <= W and y > -K:
                    best[i] = max(best[i], runs[i, 1] - runs[i, 0] + best[j] - C / 2 * (x + y))
        assert np.allclose(passages.chain_scores(runs)[0], best)


def test_a_long_run_far_away_hides_no_near_one():
    runs = np.array([[0, 200, 1000], [300, 310, 1300], [312, 330, 1312]])
    assert sorted(c[:, 0].tolist() for c in passages.chain(runs)) == [[0], [300, 312]]


def test_chain_is_collinear():
    runs = np.array([[0, 10, 100], [12, 20, 112], [14, 30, 50], [25, 40, 126]])
    first = passages.chain(runs)[0]
    assert first.tolist() == [[0, 10, 100], [12, 20, 112], [25, 40, 126]]


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in r.normal(0, 0.2, 12)], 0) for i in range(300)]
    rows += [(400, None, 1), (420, [None, 1.0], 1), (440, [float("nan"), 1.0], 1), (460, rows[20][1], 1), (20, rows[20][1], 0)]
    got = maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 20).toPandas()
    good = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v, _ in rows if i < 300 or i == 460}
    for q in (i for i in good if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert [(-s, i) for s, i in zip(own.score, own.vec_id)] == best
    assert set(got.query_id) == {i for i in good if i % 20 == 0}
    assert maxscore.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def _whole(c, x):
    """Ids of a text by one lattice, the best weight, and the ids of a plain quadratic search under the same rule."""
    s = c.write(x)
    best, start = [0] + [None] * len(s), [None] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - c.longest), j):
            w = c.weight.get(s[i:j], c.unknown if j == i + 1 else None)
            if w is not None and best[i] is not None and (best[j] is None or best[i] + w > best[j]):
                best[j], start[j] = best[i] + w, i
    ids, j = [], len(s)
    while j:
        p = s[start[j] : j]
        ids = ([c.id[p]] if p in c.id else [c.byte_id[b] for b in p.encode()]) + ids
        j = start[j]
    return ids


def _texts(r, trials):
    for trial in range(trials):
        yield "".join(r.choice(["a", "the", "  ", " ", "of", "é", "漢", "▁", "zq", "\U0010fffd", "\n", "==="]) for _ in range(120)) if trial % 3 else "".join(r.choice("abcdething=") for _ in range(200))


def test_codec_words_of_the_library_are_the_best_paths(spark):
    c = piece_codec.Codec(piece_codec.read_model())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    words = sorted({piece_codec.MARK + w for t in texts for w in t.split(" ") if len(w) < piece_codec.LONG_WORD})
    assert len(words) > 20_000 and all(c.path(w) == ids for w, ids in zip(words, c.sp.encode(words)))


def test_codec_words_are_the_whole_text():
    c = piece_codec.Codec(piece_codec.read_model())
    for x in [*_texts(random.Random(5), 30), " a  b ", "\n", "a \n b\n", " ", "\n\nx"]:
        ids = np.frombuffer(c.encode(x), "<i4").tolist()
        assert ids == _whole(c, x) == c.path(c.write(x)) and c.decode(ids) == x


@pytest.mark.parametrize("size", [7, 20, 50, 25_000])
def test_codec_chunks_are_the_whole_text(size):
    c = piece_codec.Codec(piece_codec.read_model())
    for x in _texts(random.Random(size), 12):
        s = c.write(x)
        chunks = [(s[i : i + size + c.longest - 1], min(size, len(s) - i)) for i in range(0, len(s), size)]
        entry, entries = piece_codec.Matrices(c.longest).first(), []
        for q in chunks:
            entries.append(entry[0])
            entry = piece_codec.combine(entry, c.matrix(*q))
        state, ids = np.array([0]), []
        for q, v in zip(reversed(chunks), reversed(entries)):
            ids = c.chunk_ids(*q, v, int(state[0])) + ids
            state = piece_codec.compose(state, c.map_back(*q, v))
        assert ids == _whole(c, x) and state[0] == 0
    a, b, d = (np.random.default_rng(k).integers(-9, 9, (4, 4)) for k in range(3))
    assert (piece_codec.combine(piece_codec.combine(a, b), d) == piece_codec.combine(a, piece_codec.combine(b, d))).all()


def test_codec_round_trip(spark, docs, empty, monkeypatch):
    c = piece_codec.Codec(piece_codec.read_model())
    text = {r[0]: r[1] for r in table()}
    found = []
    monkeypatch.setattr(piece_codec, "RUN", 3)
    for giant, chunk in ((1 << 30, 1), (500, 37), (500, 1000)):
        encoded = piece_codec.encode(docs, giant=giant, chunk=chunk, keep=("size",)).cache()
        got = piece_codec.decode(encoded).collect()
        assert len(got) == docs.count() and all(r.text == text[r.doc_id] for r in got)
        found.append(sorted(((r.doc_id, r.ids, r.size) for r in encoded.collect()), key=repr))
    assert found[0] == found[1] == found[2]
    for r in piece_codec.encode(docs, giant=500, chunk=64, give=piece_codec.DIGEST).collect():
        x = text[r.doc_id]
        ids = None if x is None else np.frombuffer(c.encode(x), "<i4")
        assert (r.n_tokens, r.ids_crc32, r.decoded_crc32) == ((None,) * 3 if x is None else (len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(x.encode())))
    assert piece_codec.encode(empty).count() == 0


def _plain_lm(rows, classes, core_share, listed_share):
    """doc_id: (n_tokens, n_known, N, base, score) by a plain version of the model. Words are kept by hash, which breaks ties."""
    texts = []
    for row in rows:
        text = (row[1] or "").encode()
        for _, _, data, offsets in T.slices(pa.array([row[1]], pa.string())):
            h, form, _ = brown_lm._tokens(data, offsets)
        texts.append((row[0], row[0] is not None and zlib.crc32(str(row[0]).encode()) % 10 == 0, h.tolist() if text else [], form.tolist() if text else []))
    train = [(h, f) for _, held, h, f in texts if not held]
    counts = Counter(x for h, _ in train for x in h)
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    core = sorted(w for w in counts if counts[w] >= max(1, n / core_share))
    listed = {w for w in counts if counts[w] >= max(1, n / listed_share)}
    place, size = {w: k for k, w in enumerate(core)}, len(core) + brown_lm.FORMS + 1
    bigrams = np.zeros((size, size), np.int64)
    symbols = [[*(place.get(w, len(core) + f) for w, f in zip(*t)), size - 1] for t in train]
    for x in symbols:
        for a, b in zip([size - 1, *x], x):
            bigrams[a, b] += 1
    cls = brown_lm.exchange(bigrams, len(core), classes)
    end = int(cls.max())
    logs = brown_lm.neighbour_logs(bigrams, cls)
    forms = {w: f for t in train for w, f in zip(*t)}
    around = {w: np.zeros(2 * int(cls.max() + 1), np.int64) for w in counts}
    for (h, _), x in zip(train, symbols):
        c = [int(cls[-1]), *(int(cls[k]) for k in x)]
        for i, w in enumerate(h):
            around[w][c[i]] += 1
            around[w][int(cls.max()) + 1 + c[i + 2]] += 1

    def best(w):
        fits, own = np.round(around[w] @ logs, 6), end - brown_lm.FORMS + forms[w]
        top = int(np.argmax(fits[: end - brown_lm.FORMS]))
        return top if fits[top] - fits[own] > brown_lm.EVIDENCE else own

    of = {w: int(cls[place[w]]) if w in place else best(w) for w in counts}
    pairs, histories = Counter(), {}

    def steps(h, f):
        history = end
        for w, form in zip(h, f):
            yield w, history, of.get(w, end - brown_lm.FORMS + form)
            history = of[w] if w in listed else end - brown_lm.FORMS + form
        yield "end", history, end

    for h, f in train:
        pairs.update((a, c) for _, a, c in steps(h, f))
    share = Counter({end: len(train) + 0.1} | {end - 1 - f: 0.1 for f in range(brown_lm.FORMS)})
    for w in counts:
        share[of[w]] += counts[w] + 0.1
    total = sum(share.values())
    seen = Counter()
    for (a, _), k in pairs.items():
        seen[a] += k
    out = {}
    for i, _, h, f in texts:
        base = score = known = 0
        for w, a, c in steps(h, f):
            k = len(train) if w == "end" else counts[w]
            known += k > 0
            base += log10((k + 0.1) / (n + 0.1 * (v + 1)))
            score += log10((pairs[a, c] + brown_lm.BACKOFF * share[c] / total) / (seen[a] + brown_lm.BACKOFF) * (k + 0.1) / share[c])
        out[i] = (len(h) + 1, known, n, base, score)
    for a in range(end + 1):  # after any history: all words, the end and an unseen word of each form
        p = sum((pairs[a, c] + brown_lm.BACKOFF * share[c] / total) / (seen[a] + brown_lm.BACKOFF) for c in share)
        assert abs(p - 1) < 1e-9
    assert abs(total - (n + 0.1 * (v + brown_lm.FORMS))) < 1e-6
    return out


@pytest.mark.parametrize("shares", [(30, 60), (1000, 1 << 17)])
def test_lm(docs, empty, shares):
    expected = _plain_lm(table(), 8, *shares)
    got = brown_lm.lm_score(docs, classes=8, core_share=shares[0], listed_share=shares[1]).collect()
    assert len(got) == docs.count()
    for r in got:
        n_tokens, known, n, base, score = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, known, n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and abs(r.score - score) < 1e-6 * abs(score)
    assert brown_lm.lm_score(empty).count() == 0


def test_lm_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    counts, weights = r.integers(0, 50, (9, 6)), r.random(6)
    assert np.allclose((10 ** brown_lm.transition_logs(counts, weights) * weights).sum(1), 1)


def test_lm_predicts_held_out_texts(spark):
    held = brown_lm.lm_score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert held.score.sum() > held.base_score.sum() * 0.97


def test_language(docs, empty):
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    text = {r[0]: r[1] for r in table()}
    for i, r in got.items():
        assert r.lang_pred in ("en", "fr", "und") and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(ch.isalpha() for ch in text[i] or ""))
    assert language_id.language_id(empty).count() == 0


def test_language_filters_return_all_languages_of_a_gram(spark):
    d = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("abcd abcd", "x"), ("abcd wxyz", "y"), ("wxyz", "z"), ("qrst", "z")])], "doc_id long, text string, lang string")
    filters = language_id.fit(d, hold_out=(1 << 30, 7))
    assert filters.langs == ["x", "y", "z"]
    for word, langs in (("abcd", 3), ("wxyz", 6), ("qrst", 4)):
        for _, _, data, offsets in T.slices(pa.array([word])):
            for h, _ in language_id.grams(data, offsets):
                assert all(int(m) & langs == langs for m in filters.look_up(h, 0))
    names, scores = language_id.predict(filters, pa.array(["abcd", "wxyz qrst", None, "12"]))
    assert names == ["x", "z", "und", "und"] and 0 < scores[0] <= 1 and scores[2] == 0


def test_language_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.language_id(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.98


def _plain_features(text):
    """Four bins a word: the word, the pair with the one before, and the same of their shapes (runs of byte kinds)."""
    mask = (1 << 64) - 1
    one = lambda b, lower: int(T.range_hash(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), lower=lower)[0])
    mix = lambda x: int(T.mix(np.array([x & mask], np.uint64))[0])
    out, before, shape_before = [], 0, 0
    for w in WORD.findall(text or ""):
        b = w.encode()
        kinds = [int(quality_classifier.KIND[x]) for x in b]
        shape = one(bytes(k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k), False) ^ 0x5A5A
        word = one(b, True)
        out.append([x % quality_classifier.BINS for x in (word, 77 if word == before else mix(before * 3 + word), shape, mix(shape_before * 5 + shape))])
        before, shape_before = word, shape
    return out or [[quality_classifier.BINS - 1] * 4]


def test_classifier_scores_and_training_are_the_plain_ones():
    r = np.random.default_rng(9)
    weights = r.normal(0, 1, quality_classifier.BINS + 1).astype(np.float32)
    texts = ["Buy NOW!!! buy now 12,5", "a a a b", "", None, "éa É #x # | word", " one\ntwo  one two "]
    score = quality_classifier.scorer(weights)
    for t, got in zip(texts, score(pa.array(texts))):
        bins = _plain_features(t)
        logit = float(weights[-1]) + quality_classifier.SCALE * sum(float(weights[b]) for w in bins for b in w) / len(bins)
        assert abs(got - 1 / (1 + np.exp(-logit))) < 1e-6
    rows = []
    for k, t in enumerate(texts):
        for _, _, data, offsets in T.slices(pa.array([t], pa.string())):
            (at, x), = quality_classifier._examples(data, offsets)
        bins = Counter(b for w in _plain_features(t) for b in w)
        total = sum(bins.values()) / 4
        assert dict(zip(at.tolist()[:-1], x.tolist()[:-1])) == pytest.approx({b: quality_classifier.SCALE * n / total for b, n in bins.items()}) and at[-1] == quality_classifier.BINS and x[-1] == 1
        rows.append((at, x, k % 2, 1.0 + k))
    z, n, alpha, beta, l1, l2 = Counter(), Counter(), 0.3, 1.0, 1e-4, 1e-3
    weight = lambda b: 0.0 if abs(z[b]) <= l1 else ((1 if z[b] > 0 else -1) * l1 - z[b]) / ((beta + n[b] ** 0.5) / alpha + l2)
    for _ in range(quality_classifier.EPOCHS):
        for at, x, label, share in rows:
            w = {int(b): weight(int(b)) for b in at}
            p = 1 / (1 + np.exp(-sum(w[int(b)] * v for b, v in zip(at, x))))
            for b, v in zip(at.tolist(), x.tolist()):
                g = share * (p - label) * v
                sigma = ((n[b] + g * g) ** 0.5 - n[b] ** 0.5) / alpha
                z[b] += g - sigma * w[b]
                n[b] += g * g
    got = quality_classifier.train(rows)
    assert all(abs(got[b] - weight(b)) < 1e-5 for b in z) and np.count_nonzero(got) == sum(weight(b) != 0 for b in z)


def test_classifier(spark, docs, empty, labels):
    got = quality_classifier.quality_classifier(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality_classifier.quality_classifier(empty, labels).count() == 0
    assert {r.score for r in quality_classifier.quality_classifier(docs, labels.limit(0)).collect()} == {0.5}
    d, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = quality_classifier.quality_classifier(d, known).where("held_out").join(known, "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.95


def test_rules(spark, docs, empty, labels):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    for i, t, *_ in table():
        w = WORD.findall(t or "")
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty, labels).count() == 0


def test_rules_are_learned():
    r = np.random.default_rng(1)
    x = {"a": r.random(3000), "b": r.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.5)
    rules = quality_rules.learn_rules(x, bad)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= rule.holds(x)
    assert (hit == bad).mean() > 0.97


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and got.columns == ["doc_id", "part", "row", "ids"]
