from pyspark.sql import functions as F

from weft.functions import text as X
from weft.operators import clusters as C
from weft.operators import context as K
from weft.operators import graph as G
from weft.streaming.incremental import refresh


def test_alpha_rename_and_shares(spark):
    row = spark.createDataFrame([(["a", "b", "a", "7", "c"],)], "t array<string>").select(X.alpha_rename(F.col("t")).alias("r"), X.literal_share(F.col("t")).alias("s")).first()
    assert row.r == ["Id#1", "Id#2", "Id#1", "Num", "Id#3"] and row.s == 0.2


def test_paths(spark):
    paths = ["src/attest.ts", "src/latest/x.ts", "src/a.test.ts", "test/x.ts", "a/__tests__/b.ts", "x/dist/y.ts", "dist.ts"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", X.is_test_path(F.col("p")).alias("t"), X.in_generated_directory(F.col("p")).alias("g"), X.module_by_depth(F.col("p"), 1).alias("m")).collect()
    assert [r.t for r in got] == [False, False, True, True, True, False, False]
    assert [r.g for r in got] == [False, False, False, False, False, True, False]
    assert [r.m for r in got] == ["src", "src", "src", "test", "a", "x", "<root>"]


def test_banner(spark):
    texts = ["// x\n// @generated\ncode", "code\n// @generated", "/* auto-generated\n*/ y", "#!/bin/x\n\n// Generated by z", ""]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.has_generated_banner(F.col("t"))).collect()] == [True, False, True, True, False]


def test_interval_union(spark):
    ranges = spark.createDataFrame([(1, 0, 10), (1, 5, 12), (1, 20, 25), (1, 21, 22), (2, 3, 4)], "doc_id long, start_at long, end_at long")
    assert {r.doc_id: r.covered for r in C.covered(ranges).collect()} == {1: 17, 2: 1}


def test_score_of_a_known_case(spark):
    copies = spark.createDataFrame([("c", i, f"m{i}", 14) for i in range(4)], "cluster_id string, doc_id long, source string, n long")
    row = C.scored(copies, F.lit(False), F.col("n"), "L1").first()
    assert row.recoverable_lines == 37 and row.score == 83.25 and row.tag == "source"


def test_subsume_levels(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    clusters = spark.createDataFrame([("big", "L1", 9), ("same", "L1", 5), ("exact", "L0", 4), ("some", "L1", 3)], "cluster_id string, level string, node_count long")
    pairs = spark.createDataFrame([("big", "same", 9, 11), ("big", "exact", 5, 5), ("big", "some", 2, 3), ("same", "some", 3, 3)], "outer_id string, inner_id string, contained long, of long")
    assert sorted(r.cluster_id for r in C.subsume(pairs, clusters).collect()) == ["big", "exact", "some"]


def test_graph(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    reach = G.closure(edges)
    assert G.propagation_cost(reach, nodes).first().pairs == 6
    assert {r.node: r.component for r in G.scc(reach, nodes).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}
    assert {r.node: r.component for r in G.strong_components(edges, nodes).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_strong_components_are_those_of_the_closure(spark, tmp_path):
    import random

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = random.Random(3)
    edges = spark.createDataFrame([(r.randrange(40), r.randrange(40)) for _ in range(60)], "src int, dst int").where("src <> dst").distinct()
    nodes = spark.createDataFrame([(k,) for k in range(45)], "node int")
    assert sorted(G.strong_components(edges, nodes).collect()) == sorted(G.scc(G.closure(edges), nodes).collect())


def test_cut_search_breaks_a_ring():
    edges = [{"src": a, "dst": b, "weight": w, "type_only": False} for a, b, w in (("a", "b", 5), ("b", "c", 2), ("c", "a", 9))]
    assert G.cut_search(["a", "b", "c"], edges) == {"cut": edges[1], "residual": 1, "rejected": None}
    assert G.cut_search(["a", "b", "c"], edges, {("a", "b")}) == {"cut": None, "residual": 1, "rejected": None}
    assert G.cut_search(["a", "b", "c"], edges, crossing=False)["cut"] is None and G.cut_search([], []) == {"cut": None, "residual": 0, "rejected": None}
    mesh = [{"src": a, "dst": b, "weight": 1, "type_only": False} for a in "abcd" for b in "abcd" if a != b] + [{"src": "d", "dst": "e", "weight": 1, "type_only": False}, {"src": "e", "dst": "a", "weight": 1, "type_only": False}]
    assert G.cut_search(list("abcde"), mesh) == {"cut": None, "residual": 5, "rejected": 4}
    assert G.largest_component(["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a")]) == 3


def test_forwarded_stops_at_its_start(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "w"), ("w", "v")], "src string, dst string")
    assert {r.node: r.target for r in G.forwarded(edges).collect()} == {"a": "b", "b": "a", "x": "w", "y": "v", "z": "v", "w": "v"}


def test_variations_label(spark):
    copies = spark.createDataFrame([("c", 1, ["width", "3", "x"]), ("c", 2, ["width", "4", "x"])], "cluster_id string, copy int, words array<string>")
    row = K.variations(copies).first()
    assert (row.at, row.label, row.distinct_values) == (1, "width", 2)


def test_near_variants(spark):
    base = "a b c d e f g h i j k l".split()
    streams = spark.createDataFrame([("x", 1, 0, 9, base), ("y", 2, 0, 9, base[:-1] + ["z"]), ("z", 1, 5, 20, base)], "id string, doc_id long, start_at long, end_at long, words array<string>")
    got = {(r.id, r.variant): r.similarity for r in K.near_variants(streams).collect()}
    assert ("x", "z") not in got and round(got["x", "y"], 3) == round(7 / 9, 3)


def test_incremental_cache_is_the_full_run(spark, tmp_path):
    def derive(files):
        return files.select("path", "content_hash", F.length("content_hash").alias("n"))

    one = spark.createDataFrame([("a", "h1"), ("b", "h2")], "path string, content_hash string")
    two = spark.createDataFrame([("a", "h1"), ("b", "changed"), ("c", "h3")], "path string, content_hash string")
    refresh(spark, str(tmp_path), "cfg", one, derive)
    got = refresh(spark, str(tmp_path), "cfg", two, derive)
    assert sorted(got.collect()) == sorted(derive(two).collect())


def test_a_batch_leaves_the_rows_of_other_paths(spark, tmp_path):
    from weft.streaming.incremental import Cache, clear, follow

    def derive(files):
        return files.select("path", "content_hash", F.length("text").alias("n"))

    source, cache = tmp_path / "in", str(tmp_path / "cache")
    source.mkdir()
    for k, rows in enumerate(([("a", "one"), ("b", "two")], [("c", "three")], [("a", "changed"), ("b", "two")])):
        spark.createDataFrame(rows, "path string, text string").coalesce(1).write.mode("append").json(str(source))
        follow(spark, spark.readStream.schema("path string, text string").json(str(source)), cache, "cfg", derive, str(tmp_path / "state")).awaitTermination()
        got = {r.path: r.n for r in Cache(spark, cache, "cfg").read().collect()}
        assert got == [{"a": 3, "b": 3}, {"a": 3, "b": 3, "c": 5}, {"a": 7, "b": 3, "c": 5}][k]
    assert clear(spark, cache) and Cache(spark, cache, "cfg").read() is None and not clear(spark, cache)


def test_a_cache_that_cannot_be_read_counts_as_absent(spark, tmp_path):
    from weft.streaming.incremental import Cache

    files = spark.createDataFrame([("a", "h1"), ("b", "h2")], "path string, content_hash string")
    cache = Cache(spark, str(tmp_path), "cfg")
    cache.refresh(files, lambda f: f)
    for part in (tmp_path / "schema-1" / "cfg" / "v0").glob("*.parquet"):
        part.write_bytes(b"broken")
    for part in (tmp_path / "schema-1" / "cfg" / "v0").glob(".*.crc"):
        part.unlink()
    assert cache.read() is None and cache.versions() == []
    assert sorted(cache.refresh(files, lambda f: f).collect()) == sorted(files.collect())


def test_owners_and_forwarding(spark):
    from weft.operators import imports as I
    from weft.sources import project as P

    paths = spark.createDataFrame([("a/b/x.ts",), ("a/y.ts",), ("z.ts",), ("q/w/v.ts",)], "path string")
    got = {r.path: r.owner for r in P.owners(paths, spark.createDataFrame([("a/b",), ("",)], "folder string")).collect()}
    assert got == {"a/b/x.ts": "a/b", "a/y.ts": ".", "z.ts": ".", "q/w/v.ts": "."}
    got = {r.path: r.owner for r in P.owners(paths, spark.createDataFrame([("a/b",)], "folder string")).collect()}
    assert got == {"a/b/x.ts": "a/b", "a/y.ts": "a", "z.ts": ".", "q/w/v.ts": "q"}
    bindings = spark.createDataFrame([("a/x.ts", s) for s in ("./y", "../b/I.js", "./dir", "pkg", "../../up", "./gone")], "path string, specifier string")
    files = spark.createDataFrame([("a/y.tsx",), ("b/i.ts",), ("a/dir/index.ts",), ("up.ts",)], "path string")
    assert {r.specifier: r.target for r in I.resolve(bindings, files).collect()} == {"./y": "a/y.tsx", "../b/I.js": "b/i.ts", "./dir": "a/dir/index.ts", "../../up": "up.ts"}


def test_similar_pairs_are_all_pairs(spark):
    import random

    r = random.Random(2)
    rows = [(f"{k}", [r.choice("abc") for _ in range(r.randint(4, 12))]) for k in range(80)]
    grams = {i: {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    expected = {(a, b) for a in grams for b in grams if a < b and grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.7 * len(grams[a] | grams[b])}
    streams = spark.createDataFrame(rows, "id string, words array<string>")
    assert {(x.u, x.v) for x in K.similar_pairs(streams).collect()} == expected
    assert {(x.u, x.v) for x in K.lsh_pairs(streams).collect()} <= expected


def test_similar_pairs_by_both_ways(spark):
    """Lines that share frequent shingles are found whatever is frequent; long ones fill the bits; rows may hold one text."""
    import random

    r = random.Random(5)
    rows = []
    for k in range(60):
        base = [r.choice("abcdefgh") for _ in range(r.choice([5, 6, 9, 40, 300]))]
        rows += [(f"{k}-{c}", " ".join(w if r.random() > 0.02 else "x" for w in base)) for c in range(4)]
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    expected = {(a, b): round(len(grams[a] & grams[b]) / len(grams[a] | grams[b]), 6) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.7 * len(grams[a] | grams[b])}
    streams = spark.createDataFrame(rows, "id string, stream string")
    for few in (1, 3, 256):
        assert {(x.u, x.v): x.similarity for x in K.similar_pairs(streams, few=few, words=F.split("stream", " ")).collect()} == expected


def test_html_rows_are_handed_on_in_parts():
    import pandas as pd

    from weft.sources import html as parser

    frame = pd.DataFrame({"page_id": range(30), "html": ["<div>" + "<p>a b</p>" * 999 + "</div>"] * 30})
    parts = list(parser._parse(iter([frame.iloc[:10], frame.iloc[10:]])))
    assert max(map(len, parts)) <= parser.ROWS and sum(map(len, parts)) == 30_000 and sorted(set(pd.concat(parts)["page_id"])) == list(range(30))


def test_html_fragments(spark):
    from weft.sources.html import html_fragments

    pages = [(1, "<div><p>one two three<p>one two three</div><ul><li>a <b>b</b> c<li>a <b>x</b> c</ul>"), (2, "<p>" * 300 + "deep" + "<div>" * 300), (3, None), (4, "")]
    rows = [r for r in html_fragments(spark.createDataFrame(pages, "page_id long, html string"), 1).collect()]
    first = {r.seq: r for r in rows if r.page_id == 1}
    assert [first[k].kind for k in sorted(first)] == ["p", "p", "div", "li", "li", "ul"] and [first[k].node_count for k in sorted(first)] == [4, 4, 9, 5, 5, 11]
    assert first[0].l0 == first[1].l0 and first[3].l0 != first[4].l0 and first[3].l1 == first[4].l1 and first[0].parent_id == first[1].parent_id == 0 and first[2].parent_id == -1
    assert (first[0].start_at, first[0].end_at) == (5, 21) and sum(r.page_id == 2 for r in rows) == 600 and not [r for r in rows if r.page_id > 2]


def test_lines_are_hashed_once_for_a_query(spark):
    """What reads copies and clusters of lines reads them from one written table, not from the documents again for each."""
    from weft import catalogue

    made = catalogue.queries()
    for name in ("cluster_rerank", "field_drift", "redundant_coverage", "recoverable_score", "variation_labels"):
        plan = made[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" not in plan, name


def test_lsh_pairs_are_those_of_plain_signatures(spark):
    """Buckets of 2 to ``largest`` in a band, by signatures made one hash at a time; the lines are signed once and their bands move once."""
    import random
    from collections import defaultdict

    from weft.functions.hashing import hash_of

    r = random.Random(9)
    rows = []
    for k in range(40):
        base = [r.choice("abcdefgh") for _ in range(r.choice([5, 6, 9, 40, 300]))]
        rows += [(f"{k}-{c}", " ".join(w if r.random() > 0.03 else "x" for w in base)) for c in range(r.choice([2, 5]))]
    rows += [(f"many-{c:02}", " ".join(["q"] * 6 + ["z"] * (c + 5))) for c in range(12)] + [("short", "a b c")]
    grams = {i: {" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    every = sorted(set().union(*grams.values()))
    hashed = {x.g: x.h for x in spark.createDataFrame([(g,) for g in every], "g string").select("g", F.xxhash64("g").alias("h")).collect()}
    masks = [int(hash_of(f"mask {k}")[:16], 16) - (1 << 63) for k in range(128)]
    streams = spark.createDataFrame(rows, "id string, stream string")
    for largest in (40, 4):
        buckets = defaultdict(list)
        for i in sorted(i for i in grams if grams[i]):
            sig = [min(hashed[g] ^ m for g in grams[i]) for m in masks]
            for b in range(32):
                buckets[b, *sig[4 * b : 4 * b + 4]].append(i)
        agreed = {(u, v) for of in buckets.values() if 2 <= len(of) <= largest for u in of for v in of if u < v}
        alike = {(u, v): len(grams[u] & grams[v]) / len(grams[u] | grams[v]) for u, v in agreed}
        found = K.lsh_pairs(streams, largest=largest, words=F.split("stream", " "))
        assert {(x.u, x.v): x.similarity for x in found.collect()} == {pair: round(s, 6) for pair, s in alike.items() if s >= 0.7} != {}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1, plan


def test_near_variants_are_the_best_of_all(spark):
    """Against all pairs, with a shingle that most streams share; pairs are never made of the shingles that two streams happen to share."""
    import random

    from weft import catalogue

    r = random.Random(4)
    rows = []
    for k in range(70):
        base = [r.choice("abcdefgh") for _ in range(r.choice([4, 5, 9, 20]))]
        rows += [(f"{k}-{c}", r.randrange(9), at := r.randrange(40), at + 9, ["h"] * 6 * (k % 2) + [w if r.random() > 0.05 else "x" for w in base]) for c in range(3)]
    grams = {x[0]: {tuple(x[4][k : k + 5]) for k in range(len(x[4]) - 4)} for x in rows}
    expected = {}
    for a in rows:
        near = [(-round(len(grams[a[0]] & grams[b[0]]) / len(grams[a[0]] | grams[b[0]]), 6), b[0]) for b in rows if a != b and grams[a[0]] & grams[b[0]] and not (a[1] == b[1] and a[2] < b[3] and b[2] < a[3])]
        expected |= {(a[0], i): (-s, place) for place, (s, i) in enumerate(sorted(x for x in near if x[0] <= -0.6)[:3], 1)}
    streams = spark.createDataFrame(rows, "id string, doc_id long, start_at long, end_at long, words array<string>")
    assert {(x.id, x.variant): (x.similarity, x.place) for x in K.near_variants(streams).collect()} == expected != {}
    plan = catalogue.queries()["near_variants"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "array_join" not in plan


def test_module_graph_is_grouped_in_one_pass(spark):
    """Against plain sums; modules by a table or by a rule; votes are summed over targets, ties go to the smallest; lines are read for bindings and offers only."""
    import random
    from collections import Counter

    from weft import catalogue
    from weft.operators import imports as I

    r = random.Random(6)
    pairs = {(f"{r.choice('abc')}/{r.randrange(5)}", f"{r.choice('abc')}/{r.randrange(5)}") for _ in range(90)}
    detail = [(p, t, r.randrange(3), 0, r.random() < 0.3, r.randrange(2), r.choice([None, "x/1", "y/2", "c/3"])) for p, t in sorted(pairs) if p != t]
    frame = spark.createDataFrame(detail, "path string, target string, symbols long, erased long, erasable boolean, pass_through long, origin string")
    expected = {}
    for s, t in {(d[0][0], d[1][0]) for d in detail if d[0][0] != d[1][0]}:
        of = [d for d in detail if (d[0][0], d[1][0]) == (s, t)]
        weights, votes = Counter(), Counter(d[6] for d in of if d[6])
        for d in of:
            weights[d[1]] += max(d[2], 1)
        top = min((-w, x) for x, w in weights.items())
        expected[s, t] = (sum(d[2] for d in of), sorted({d[0] for d in of}), top[1], -top[0], sum(d[5] for d in of), min(((-n, o) for o, n in votes.items()), default=(0, None))[1], all(d[4] for d in of))
    of = spark.createDataFrame([(f"{m}/{k}", m) for m in "abc" for k in range(5)] + [("x/1", "x"), ("y/2", "y")], "path string, module string")
    gone = {}
    for how in (of, lambda path: F.substring(path, 1, 1)):
        made = I.module_graph(frame, how)
        assert {(x.src, x.dst): (x.weight, x.files, x.top_target, x.top_weight, x.pass_through, x.origin, x.type_only) for x in made.collect()} == expected
        gone[callable(how)] = [tuple(x) for x in I.dissolves(made, how, 0.4).select("src", "dst", "origin", "origin_module").collect()]
    assert gone[True] == gone[False] != []
    for name in ("module_graph", "dissolves"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") <= 3, name
