"""Looser levels of likeness and splits of the duplicated mass: forms without names, near pairs of them, packages, granularities.

Shapes are rows id, path, start_at, end_at and words (the stream that is compared).
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text as X
from weft.operators import context as K
from weft.operators import graph as G


def representatives(fragments: DataFrame) -> DataFrame:
    """One fragment (doc_id, start_at, end_at, seq, words) of each form without names: the first, as id (the form's hash), its place
    and words, and how many fragments have the form."""
    rows = fragments.withColumn("id", X.stream_hash(X.erased(F.col("words"))))
    first = F.min(F.struct("doc_id", "start_at", "end_at", "seq", "words"))
    return rows.groupBy("id").agg(first.alias("x"), F.count("*").alias("copies")).select("id", "x.doc_id", "x.start_at", "x.end_at", "x.words", "copies")


def without_nested(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """The pairs (u, v) of which neither holds the other: not the same document with one range within the other."""
    side = {s: shapes.select(F.col("id").alias(s), F.col("doc_id").alias(f"doc_{s}"), F.col("start_at").alias(f"a_{s}"), F.col("end_at").alias(f"z_{s}")) for s in "uv"}
    within = "(a_u <= a_v and z_v <= z_u) or (a_v <= a_u and z_u <= z_v)"
    return pairs.join(side["u"], "u").join(side["v"], "v").where(f"not (doc_u = doc_v and ({within}))").select(*pairs.columns)


def clusters_of(pairs: DataFrame) -> DataFrame:
    """node, label: connected components of pairs (u, v); the label is the smallest node."""
    both = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))  # in one pass over the pairs
    edges = pairs.select(F.explode(both).alias("x")).select("x.u", "x.v").distinct().checkpoint()
    labels = edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")).checkpoint()
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("there"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "there").alias("new"))
        above = labels.select(F.col("node").alias("new"), F.col("label").alias("up"))
        step = lower.join(above, "new").select("node", F.least("new", "up").alias("label"), (F.least("new", "up") < F.col("label")).alias("changed")).checkpoint()
        labels = step.select("node", "label")
        if step.where("changed").isEmpty():
            return labels


def near_shapes(fragments: DataFrame, similar: float = 0.7) -> DataFrame:
    """The clusters of different forms that are alike: MinHash bands give candidates, exact similarity over ``similar`` decides, nested ones
    are left out: node, label."""
    shapes = representatives(fragments)
    return clusters_of(without_nested(K.lsh_pairs(shapes, similar=similar), shapes))


def merkle(tree: dict) -> dict[int, str]:
    """id: hash of each node of a tree (id: (kind, text, children's ids)); equal subtrees have equal hashes. Each node is hashed once, from
    its children's hashes."""
    out: dict[int, str] = {}
    for top in tree:
        stack = [(top, False)]
        while stack:
            n, ready = stack.pop()
            if n in out:
                continue
            kind, text, children = tree[n]
            if ready:
                out[n] = md5("\x00".join([kind, text or "", *(out[c] for c in children)]).encode()).hexdigest()
            else:
                stack.append((n, True))
                stack += [(c, False) for c in children]
    return out


def merkle_levels(nodes: DataFrame, deepest: int) -> DataFrame:
    """The same over a table node, parent, kind, text, depth, place (among its siblings), level by level from the deepest: node, hash."""
    done = None
    for depth in range(deepest, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if done is None:
            below = F.lit("")
            hashed = level.withColumn("below", below)
        else:
            each = done.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("x")).select(F.col("parent").alias("node"), F.array_join(F.transform("x", lambda c: c["hash"]), "|").alias("below"))
            hashed = level.join(each, "node", "left").withColumn("below", F.coalesce("below", F.lit("")))
        level_done = hashed.select("node", "parent", "place", F.md5(F.concat_ws("|", "kind", F.coalesce("text", F.lit("")), "below")).alias("hash"))
        out = level_done.select("node", "hash") if done is None else out.union(level_done.select("node", "hash"))
        done = level_done
    return out


def granularity_table(imports: DataFrame, paths: DataFrame, deepest: int = 3) -> DataFrame:
    """imports: path, target. For each depth: label, modules, edges (between modules), intra (imports within one), cycles, largest, and
    files_a_module."""
    rows = None
    for depth in range(1, deepest + 1):
        of, label = G.modules_of(paths, depth)
        of = of.checkpoint()
        joined = imports.join(of, "path").join(of.select(F.col("path").alias("target"), F.col("module").alias("to")), "target").where("path <> target")
        edges = joined.where("module <> to").select(F.col("module").alias("src"), F.col("to").alias("dst")).distinct()
        sizes = G.component_sizes(G.strong_components(edges, of.select(F.col("module").alias("node")).distinct()))
        totals = of.agg(F.count_distinct("module").alias("modules"), F.count("*").alias("files"))
        one = (
            totals.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(joined.agg(F.count_if(F.col("module") == F.col("to")).alias("intra")))
            .crossJoin(sizes.agg(F.count("*").alias("cycles"), F.coalesce(F.max("size"), F.lit(0)).alias("largest")))
            .select(F.lit(label).alias("label"), "modules", "edges", "intra", "cycles", "largest", F.round(F.col("files") / F.col("modules"), 6).alias("files_a_module"))
        )
        rows = one if rows is None else rows.union(one)
    return rows


def mass_by_tag(copies: DataFrame, is_test: Column, mass: DataFrame) -> DataFrame:
    """tag, clusters, mass: the duplicated mass of clusters whose copies are all of tests, none, or both. mass: cluster_id, mass."""
    tests = copies.groupBy("cluster_id").agg(F.count_if(is_test).alias("tests"), F.count("*").alias("copies"))
    tag = F.when(F.col("tests") == 0, "source").when(F.col("tests") == F.col("copies"), "test").otherwise("mixed")
    return tests.join(mass, "cluster_id").groupBy(tag.alias("tag")).agg(F.count("*").alias("clusters"), F.sum("mass").alias("mass"))


def nearest_package(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """path, package: the nearest folder above that is a package (packages: folder); a dot for none."""
    dirs = X.directories(F.col("path"))
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(dirs)), lambda k: F.array_join(F.slice(dirs, 1, k), "/"))).alias("folder"))
    found = above.join(packages.select("folder").distinct(), "folder").groupBy("path").agg(F.max(F.struct(F.length("folder").alias("n"), "folder")).alias("x")).select("path", F.col("x.folder").alias("package"))
    return paths.select("path").join(found, "path", "left").select("path", F.when(F.coalesce("package", F.lit("")) == "", ".").otherwise(F.col("package")).alias("package"))


def cross_package_share(copies: DataFrame, package: str, mass: DataFrame) -> DataFrame:
    """Of the duplicated mass, how much is of clusters with copies in two packages or more: crossing, mass, share."""
    wide = copies.groupBy("cluster_id").agg((F.count_distinct(package) > 1).alias("wide")).join(mass, "cluster_id")
    made = wide.agg(F.coalesce(F.sum(F.when(F.col("wide"), F.col("mass"))), F.lit(0)).cast("long").alias("crossing"), F.coalesce(F.sum("mass"), F.lit(0)).cast("long").alias("mass"))
    return made.select("crossing", "mass", F.round(F.coalesce(F.try_divide("crossing", "mass"), F.lit(0.0)), 6).alias("share"))


def duplication_in_tangles(copies: DataFrame, components: DataFrame, mass: DataFrame) -> DataFrame:
    """For each tangle, the clusters that have copies in two of its modules or more: component, clusters, mass. copies: cluster_id, module."""
    tangled = components.join(components.groupBy("component").agg(F.count("*").alias("size")).where("size > 1"), "component").select(F.col("node").alias("module"), "component")
    held = copies.select("cluster_id", "module").distinct().join(tangled, "module").groupBy("component", "cluster_id").agg(F.count("*").alias("n")).where("n > 1")
    return held.join(mass, "cluster_id").groupBy("component").agg(F.count("*").alias("clusters"), F.sum("mass").alias("mass"))
