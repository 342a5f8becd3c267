"""Each stage of the pipeline against a plain version on a small table: nulls, empty and long texts, repeated rows and ids, empty tables,
extra columns with names that the operators use themselves."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from weft.llm import mixing, piece_codec, quality_classifier
from weft.llm.common import cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, position string, row string, taken int, ids string, `a b` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _rows():
    r = random.Random(41)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 8))) for _ in range(800)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    shared = some(70)
    texts = [" ".join(some(n)) for n in (1, 3, 8, 30, 60, 90, 120, 200)]
    texts += [" ".join([*some(60), *shared, *some(40)]) for _ in range(3)]
    base = some(100)
    texts += [" ".join(base), " ".join(base).upper(), " ".join(base[:99]), " ".join([*base[:50], "x", *base[51:]])]
    texts += ["# | * & % " * 20, "BUY NOW!!! " * 30, None, "", " \n ", "word " * 3000]
    rows = [(k, t, "en", ("s0", "s1", None)[k % 3], 0 if t is None else len(t), -1, 0.5, "p", "r", 7, "i", "z") for k, t in enumerate(texts)]
    return [*rows, rows[4], (5, texts[6] + " more", *rows[5][2:]), (None, "a text without an id that stands here alone", *rows[5][2:]), (None, texts[7], *rows[5][2:])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(k, int(k < 15), 0) for k in range(17)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


@pytest.fixture(scope="module")
def docs(spark):
    return cut(spark.createDataFrame(_rows(), SCHEMA).repartition(3))


def _key(row):
    return repr(tuple(row))


def test_quality_scores_rows_one_by_one(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    score = quality_classifier.scorer(quality_classifier.fit(docs, labels))
    expected = [x for x in docs.collect() if score(pa.array([x.text], pa.string()))[0] >= 0.7]
    made = corpus_pipeline.quality(spark, docs, folder)
    assert made.schema == docs.schema and sorted(map(_key, made.collect())) == sorted(map(_key, expected)) and 0 < len(expected) < docs.count()
    assert quality_classifier.keep_good(docs, labels.limit(0)).count() == docs.count()


def test_near_duplicates_keep_one_of_each(spark, docs, folder):
    rows = docs.collect()
    sets = []
    for x in rows:
        w = WORD.findall((x.text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    made = corpus_pipeline.near_duplicates(spark, docs, folder)
    got = made.collect()
    assert made.schema == docs.schema and all(_key(x) in set(map(_key, rows)) for x in got)
    groups = {}
    for i, x in enumerate(rows):
        if sets[i]:
            groups.setdefault(find(i), []).append(x)
    expected = sorted((min((x.doc_id for x in g if x.doc_id is not None), default=None) for g in groups.values()), key=repr)
    with_words = [x for x in got if WORD.search(x.text or "")]
    assert sorted((x.doc_id for x in with_words), key=repr) == expected and len(got) - len(with_words) == sum(not s for s in sets)


def test_repeated_passages_go(spark, docs, folder):
    made = corpus_pipeline.repeated_passages(spark, docs, folder)
    assert made.schema == docs.schema
    before = {}
    for x in docs.collect():
        before.setdefault(x.doc_id, []).append(x)
    got = {}
    for x in made.collect():
        got.setdefault(x.doc_id, []).append(x)
    for k in (9, 10):  # the 70 words they share with document 8, or a word more by chance on either side
        left = got[k][0].text.split()
        assert 96 <= len(left) <= 100 and left[:55] == before[k][0].text.split()[:55] and got[k][0].n_chars == len(got[k][0].text)
    for k in (0, 1, 2, 3, 4, 5, 8, 11, 15, 16, 17, 18, 19):
        assert sorted(map(_key, got[k])) == sorted(map(_key, before[k]))
    assert {12, 13, 14} & set(got) <= {13, 14} and len(got[None]) == 1  # copies lose everything; of the null ids, one is a copy of document 7
    assert 6 not in got  # all of it stands in the second row of id 5
    assert all((x.text is None) == (before[x.doc_id][0].text is None) for k in got for x in got[k])


def _plain_uses(rows):
    size = [len(WORD.findall(x.text or "")) for x in rows]
    sources = sorted({x.source for x in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, x in zip(size, rows) if x.source == s) for s in sources}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sources)}
    target, full = {}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        level = left / sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and level * weight[s] >= 3 * total[s]}
        if not more:
            break
        full |= more
    target = {s: 3 * total[s] if s in full else level * weight[s] for s in sources}
    out = []
    for k, s in enumerate(sources):
        spin = lambda i: int(hashlib.md5(f"{'' if rows[i].doc_id is None else rows[i].doc_id} {size[i]}".encode()).hexdigest()[:15], 16)
        order = sorted((i for i in range(len(rows)) if rows[i].source == s), key=lambda i: (spin(i) % mixing.BUCKETS, spin(i), rows[i].doc_id is not None, rows[i].doc_id or 0, size[i]))
        start = 0
        for i in order:
            for lap in range(3):
                want = max(0, min(size[i], int(target[s] + 0.5) - start - lap * total[s]))
                if want and 2 * want >= size[i]:
                    fraction = (start + lap * total[s]) / target[s]
                    for t, m, slope, a in mixing.segments(mixing.SCHEDULES[k % 3]):
                        if fraction >= a:
                            at = t + 2 * (fraction - a) / (m + max(0.0, m * m + 2 * slope * (fraction - a)) ** 0.5)
                    out.append((fraction if fraction >= 1 else at, rows[i]))
            start += size[i]
    return out


def test_mixture_is_in_training_order(spark, docs, folder, tmp_path):
    expected = sorted(_plain_uses(docs.collect()), key=lambda x: (round(x[0], 9), repr(x[1].doc_id)))
    made = corpus_pipeline.mixture(spark, docs, folder)
    assert made.schema == docs.schema and sorted(map(_key, made.collect())) == sorted(_key(x) for _, x in expected)
    made.write.parquet(str(tmp_path / "mixed"))
    placed = corpus_pipeline.in_file_order(spark.read.parquet(str(tmp_path / "mixed"))).orderBy("part", "row").collect()
    position = {}
    for p, x in expected:
        position.setdefault((x.doc_id, x.text), []).append(p)
    found = [position[x.doc_id, x.text].pop(0) for x in placed]
    assert all(a <= b + 1e-9 for a, b in zip(found, found[1:])) and len(found) == len(expected)


def test_encoding_names_the_place(spark, docs, folder):
    codec = piece_codec.Codec(piece_codec.read_model())
    got = corpus_pipeline.encoding(spark, docs, folder).collect()
    expected = [(x.doc_id, None if x.text is None else np.frombuffer(codec.encode(x.text), "<i4").tolist()) for x in docs.collect()]
    assert sorted(((x.doc_id, x.ids) for x in got), key=repr) == sorted(expected, key=repr) and len({(x.part, x.row) for x in got}) == len(got)
    loose = corpus_pipeline.encoding(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), folder).first()
    assert loose.part is None and loose.row is None and codec.decode(loose.ids) == "a b"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_tables(spark, folder, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0


def test_whole_pipeline_is_its_stages(spark, docs, folder):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    step = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, step, folder)
        made.write.mode("overwrite").parquet(f"{folder}/step{k}")
        step = spark.read.parquet(f"{folder}/step{k}")
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == step.columns and sorted((x.doc_id, x.ids) for x in got.collect()) == sorted((x.doc_id, x.ids) for x in step.collect())
    assert got.count() > 5
