"""Module graphs: edges, argmax and mode with ties, closure, components, cycles, break suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.text import directories, module_by_depth


def module_edges(bindings: DataFrame, mode: str = "include") -> DataFrame:
    """bindings: src, dst (modules), target, erased. One row per edge: weight, erased, type_only. mode: include, exclude or only type-only edges."""
    made = bindings.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"), F.count_if(F.col("erased")).alias("erased"), F.bool_and(F.col("erased")).alias("type_only"))
    return {"include": made, "exclude": made.where("not type_only"), "only": made.where("type_only")}[mode]


def top_target(bindings: DataFrame) -> DataFrame:
    """The heaviest target of each edge, ties to the smallest."""
    each = bindings.where("src <> dst").groupBy("src", "dst", "target").agg(F.count("*").alias("w"))
    return each.groupBy("src", "dst").agg(F.min(F.struct((-F.col("w")).alias("w"), "target")).alias("x")).select("src", "dst", F.col("x.target").alias("top_target"), (-F.col("x.w")).alias("top_weight"))


def mode_origin(bindings: DataFrame, origin: str = "origin") -> DataFrame:
    each = bindings.where("src <> dst").groupBy("src", "dst", origin).agg(F.count("*").alias("n"))
    return each.groupBy("src", "dst").agg(F.min(F.struct((-F.col("n")).alias("n"), origin)).alias("x")).select("src", "dst", F.col(f"x.{origin}").alias("origin"), (-F.col("x.n")).alias("votes"))


def closure(edges: DataFrame) -> DataFrame:
    """src, dst of all pairs that a path joins, by semi-naive steps: each round joins the pairs that are new with themselves' ends, all
    pairs found so far, so that paths double in length."""
    every = edges.select("src", "dst").distinct().checkpoint()
    new = every
    while not new.isEmpty():
        after = new.join(every.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        before = every.join(new.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        new = after.union(before).distinct().join(every, ["src", "dst"], "left_anti").checkpoint()
        every = every.union(new).checkpoint()
    return every


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component: the smallest node of its strongly connected component, without the closure. Each round passes the smallest
    node forward and the smallest that was so reached backward; where both agree, a component is settled and leaves."""
    left = edges.select("src", "dst").where("src <> dst").distinct().checkpoint()
    settled = nodes.select("node", F.col("node").alias("component")).limit(0)
    while True:
        # a node without an edge in or out is a component of its own
        while True:
            live = left.select(F.col("src").alias("node")).intersect(left.select("dst"))
            kept = left.join(live.select(F.col("node").alias("src")), "src", "left_semi").join(live.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").checkpoint()
            gone, left = kept.count() == left.count(), kept
            if gone:
                break
        if left.isEmpty():
            break
        color = _passed(left, left.select(F.col("src").alias("node")).distinct().withColumn("color", F.col("node")), "src", "dst")
        c = {s: color.select(F.col("node").alias(s), F.col("color").alias(f"color_{s}")) for s in ("src", "dst")}
        inner = left.join(c["src"], "src").join(c["dst"], "dst").where("color_src = color_dst").select("src", "dst").checkpoint()
        roots = color.withColumn("color", F.when(F.col("node") == F.col("color"), F.col("color")))
        back = _passed(inner, roots, "dst", "src")
        done = back.where("color is not null").select("node", F.col("color").alias("component")).checkpoint()
        settled = settled.union(done).checkpoint()
        for end in ("src", "dst"):
            left = left.join(done.select(F.col("node").alias(end)), end, "left_anti")
        left = left.select("src", "dst").checkpoint()
    return nodes.select("node").join(settled, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _passed(edges: DataFrame, colors: DataFrame, given: str, taken: str) -> DataFrame:
    """node, color after each node has the smallest color that edges pass on to it."""
    colors = colors.checkpoint()
    while True:
        sent = edges.join(colors.select(F.col("node").alias(given), "color"), given).groupBy(F.col(taken).alias("node")).agg(F.min("color").alias("sent"))
        least = F.least("color", "sent")
        step = colors.join(sent, "node", "left").select("node", least.alias("color"), (~least.eqNullSafe(F.col("color"))).alias("changed")).checkpoint()
        colors = step.select("node", "color")
        if step.where("changed").isEmpty():
            return colors


def propagation_cost(reach: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("modules"))
    return reach.agg(F.count("*").alias("pairs")).crossJoin(n).select("modules", "pairs", F.round(F.coalesce(F.try_divide(F.col("pairs"), F.col("modules") * F.col("modules")), F.lit(0.0)), 6).alias("cost"))


def scc(reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component: the smallest node that reaches it and is reached by it."""
    both = reach.join(reach.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    least = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low"))
    return nodes.select(F.col("node")).join(least, "node", "left").select("node", F.least("node", F.coalesce("low", "node")).alias("component"))


def inner_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    a = components.select(F.col("node").alias("src"), F.col("component").alias("a"))
    b = components.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a = b").select(*edges.columns, F.col("a").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")


def granularity(paths: DataFrame, deepest: int = 6) -> DataFrame:
    """The directory depth, or files, whose number of modules is nearest to the root of the number of files, within 8..64; the earlier of
    two. Depths end with the first that has as many modules as there are files. No file: dir:1 with no module."""
    base = paths.agg(F.count("*").alias("files"))
    by_depth = paths.select(F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("depth"), "path").groupBy("depth").agg(F.count_distinct(module_by_depth(F.col("path"), F.col("depth"))).alias("modules"))
    all_files = paths.agg(F.count_distinct("path").alias("modules")).select(F.lit(deepest + 1).alias("depth"), "modules")
    near = by_depth.union(all_files).crossJoin(base).withColumn("goal", F.least(F.lit(64), F.greatest(F.lit(8), F.round(F.sqrt("files")))).cast("long"))
    label = F.when(F.col("files") == 0, "dir:1").when(F.col("depth") > deepest, "file").otherwise(F.concat(F.lit("dir:"), F.col("depth").cast("string")))
    return near.groupBy("files", "goal").agg(F.min(F.struct(F.abs(F.col("modules") - F.col("goal")).alias("off"), "depth", "modules", label.alias("label"))).alias("x")).select("files", "goal", "x.label", "x.modules")


def modules_of(paths: DataFrame, choice: str | int) -> tuple[DataFrame, str]:
    """path, module of every path, and the label of the choice: auto, file, dir, or a depth."""
    label = granularity(paths).first()["label"] if choice == "auto" else f"dir:{choice}" if isinstance(choice, int) else choice
    if label == "file":
        return paths.select("path", F.col("path").alias("module")), label
    depth = None if label == "dir" else int(label.split(":")[1])
    prefix = shared_prefix(paths).first()
    shared = int(prefix["depth"]) if prefix and prefix["depth"] is not None else 0
    return paths.select("path", module_by_depth(F.col("path"), depth, shared).alias("module")), label


def largest_component(nodes: list, edges: list[tuple]) -> int:
    """Size of the largest strongly connected component of a small graph (Kosaraju, without recursion)."""
    out: dict = {n: [] for n in nodes}
    back: dict = {n: [] for n in nodes}
    for a, b in edges:
        out[a].append(b)
        back[b].append(a)

    def walk(start, graph: dict, seen: set) -> list:
        seen.add(start)
        stack, order = [(start, iter(graph[start]))], []
        while stack:
            node, rest = stack[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(graph[step])))
        return order

    seen: set = set()
    order = [x for n in sorted(nodes) if n not in seen for x in walk(n, out, seen)]
    seen, most = set(), 0
    for n in reversed(order):
        if n not in seen:
            most = max(most, len(walk(n, back, seen)))
    return most


#: Modules of the largest tangle whose cuts are searched for; a cut must bring the largest rest down to this share of it.
MOST_MODULES, WORTH = 32, (2, 3)


def cut_search(component: list, edges: list[dict], dissolved: set[tuple] = frozenset(), crossing: bool = True, most_modules: int = MOST_MODULES) -> dict:
    """What removing one edge does to a tangle: cut (the edge, or None), residual (size of the largest component after it), rejected
    (the smallest residual that was not small enough, or None). Edges that dissolve are taken away first, and the search starts from
    what is left. Nothing is searched in a large tangle, or where no cycle of files crosses modules. Edges that hold at run time come
    first, then those of fewer files, less weight, by name; of equal residuals the first stands."""
    pairs = [(e["src"], e["dst"]) for e in edges if (e["src"], e["dst"]) not in dissolved]
    start = largest_component(component, pairs) if component else 0
    out = {"cut": None, "residual": start, "rejected": None}
    if len(component) > most_modules or not crossing or start <= 1:
        return out
    for e in sorted((e for e in edges if (e["src"], e["dst"]) not in dissolved), key=lambda e: (bool(e["type_only"]), e.get("n_files", 1), e["weight"], e["src"], e["dst"])):
        left = largest_component(component, [p for p in pairs if p != (e["src"], e["dst"])])
        if left >= start:
            continue
        if left > 1 and WORTH[1] * left > WORTH[0] * start:
            out["rejected"] = left if out["rejected"] is None else min(left, out["rejected"])
            continue
        if left < out["residual"]:
            out |= {"cut": e, "residual": left}
        if left <= 1:
            break
    return out


def shared_prefix(paths: DataFrame) -> DataFrame:
    """Length of the directories that all paths share, from the smallest and the largest one."""
    ends = paths.agg(F.min("path").alias("a"), F.max("path").alias("b"))
    a, b = directories(F.col("a")), directories(F.col("b"))
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    length = F.coalesce(F.array_position(same, False), F.lit(0))
    count = F.when(F.size(same) == 0, 0).when(length == 0, F.size(same)).otherwise(length - 1).cast("int")
    return ends.select(F.array_join(F.slice(a, 1, count), "/").alias("prefix"), count.cast("long").alias("depth"))


def forwarded(edges: DataFrame, hops: int = 3) -> DataFrame:
    """node, target: where following only successors leads within ``hops`` steps; a loop back to the start ends it; unmoved nodes are left out."""
    only = edges.groupBy("src").agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("dst")).where("n = 1").select("src", "dst")
    at: DataFrame = only.select(F.col("src").alias("node"), F.col("dst").alias("target"))
    for _ in range(hops - 1):
        step = only.select(F.col("src").alias("target"), F.col("dst").alias("following"))
        at = at.join(step, "target", "left").select("node", F.when(F.col("following") == F.col("node"), F.col("target")).otherwise(F.coalesce("following", "target")).alias("target"))
    return at.where("node <> target")


