"""What files import from each other: resolution, detail by file and target, re-exports and where names come from, the module graph.

bindings: path, declaration_id, specifier, name, local, erased, binds, reexport. Once resolved, ``target`` stands for the specifier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as X

#: What may be missing at the end of a specifier, by preference; and endings that stand for a source's.
TRIED = ("", ".ts", ".tsx", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.mts", "/index.cts")
COMPILED = r"\.([cm]?)jsx?$"


def _normal(parts):
    """Segments without dots: a double dot takes the one before it away."""
    return F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == ".") | (p == ""), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))


def resolve(bindings: DataFrame, files: DataFrame) -> DataFrame:
    """The bindings whose relative specifier names a file of ``files`` (path), as ``target``; case does not matter, endings may be
    missing or those of the compiled file. What names no file of the project is left out."""
    relative = bindings.where(F.col("specifier").startswith("."))
    base = F.array_join(_normal(F.concat(X.directories(F.col("path")), F.split("specifier", "/"))), "/")
    source = F.regexp_replace("base", COMPILED, ".$1ts")
    each = [F.struct(F.lit(k).alias("rank"), F.lower(F.concat(c, F.lit(e))).alias("folded")) for k, (c, e) in enumerate([(source, ""), (F.concat(source, F.lit("x")), ""), *((F.col("base"), e) for e in TRIED)])]
    wanted = relative.select("path", "specifier").distinct().withColumn("base", base).select("path", "specifier", F.explode(F.array_distinct(F.array(*each))).alias("x")).select("path", "specifier", "x.*")
    known = files.select(F.lower("path").alias("folded"), F.col("path").alias("target"))
    found = wanted.join(known, "folded").groupBy("path", "specifier").agg(F.min(F.struct("rank", "target"))["target"].alias("target"))
    return relative.join(found, ["path", "specifier"])


def check_owned(paths: DataFrame, module_of: DataFrame) -> None:
    """Raises if a file has no module."""
    lone = paths.select("path").join(module_of, "path", "left_anti").orderBy("path").limit(1).collect()
    if lone:
        raise ValueError(f"{lone[0]['path']} is not a file of the project")


def most_frequent(votes: Column) -> Column:
    """Of an array of structs (v, n), the v with the largest sum of n, ties to the smallest; null for none. One pass over the sorted array."""
    none = F.struct(F.lit(0).cast("long").alias("most"), F.lit(None).cast("string").alias("best"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("v"))

    def add(acc: Column, x: Column) -> Column:
        n = x["n"] + F.when(acc["v"] == x["v"], acc["n"]).otherwise(F.lit(0).cast("long"))
        return F.struct(F.greatest(acc["most"], n).alias("most"), F.when(n > acc["most"], x["v"]).otherwise(acc["best"]).alias("best"), n.alias("n"), x["v"].alias("v"))

    return F.aggregate(F.sort_array(votes), none, add, lambda acc: acc["best"])


def with_module(rows: DataFrame, path: str, module: str, module_of: DataFrame | Callable[[Column], Column]) -> DataFrame:
    """Adds the module of the file in column ``path``. module_of: a table (path, module), whose lacking files drop out, or a rule that makes the module of
    a path and moves no rows."""
    if callable(module_of):
        return rows.withColumn(module, module_of(F.col(path)))
    return rows.join(module_of.select(F.col("path").alias(path), F.col("module").alias(module)), path)


def pure_forwarders(bindings: DataFrame) -> DataFrame:
    """path of the files that re-export and import nothing for themselves."""
    made = bindings.groupBy("path").agg(F.count_if(F.col("reexport")).alias("forwards"), F.count_if(~F.col("reexport")).alias("imports"))
    return made.where("forwards > 0 and imports = 0").select("path")


def export_origins(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where a file's re-exported names come from: path, local, origin for names; and path, origin for files with exactly one target of a star."""
    forwards = resolved.where("reexport")
    named = forwards.where("name <> '*' and local <> '*'").groupBy("path", "local").agg(F.min("target").alias("origin"))
    stars = forwards.where("name = '*' and local = '*'").groupBy("path").agg(F.count_distinct("target").alias("n"), F.min("target").alias("origin")).where("n = 1").select("path", "origin")
    return named, stars


def with_origins(resolved: DataFrame) -> DataFrame:
    """Adds origin: the file that the target has the imported name from, by name first, else by its only star; null where it is
    the target's own, and for bindings of all names."""
    star = F.col("name") == "*"
    both = star.eqNullSafe(F.col("local") == "*")  # of the others, no name can be told
    offers = resolved.where("reexport").where(both & F.col("name").isNotNull() & F.col("local").isNotNull()).groupBy(F.col("path").alias("target"), F.col("local").alias("name")).agg(F.min("target").alias("of_name"), F.max("target").alias("last"))
    by_star = offers.where(star & (F.col("of_name") == F.col("last"))).select("target", F.col("of_name").alias("of_star"))
    # names first: what is left lies by target, where import_detail and module_graph need it
    joined = resolved.join(offers.where(~star).drop("last"), ["target", "name"], "left").join(by_star, "target", "left")
    return joined.select(*resolved.columns, F.when(F.coalesce(F.col("name") != "*", F.lit(False)), F.coalesce("of_name", "of_star")).alias("origin"))


def import_detail(bindings: DataFrame) -> DataFrame:
    """bindings: path, target, erased, binds, origin (null: the target's own). By file and target, itself left out: symbols, erased,
    erasable (there are symbols, and all are erased), pass_through, and the commonest origin."""
    counts = {"symbols": F.col("binds"), "erased": F.col("binds") & F.col("erased"), "pass_through": F.col("binds") & F.col("origin").isNotNull()}
    each = bindings.where("path <> target").groupBy("path", "target", "origin").agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in counts.items()))
    commonest = F.min(F.when(F.col("origin").isNotNull(), F.struct((-F.col("n")).alias("n"), "origin")))["origin"]
    made = each.groupBy("path", "target").agg(*(F.sum(k).alias(k) for k in counts), commonest.alias("origin"))
    return made.select("path", "target", "symbols", "erased", ((F.col("symbols") > 0) & (F.col("erased") == F.col("symbols"))).alias("erasable"), "pass_through", "origin")


def module_graph(detail: DataFrame, module_of: DataFrame | Callable[[Column], Column], mode_: str = "include") -> DataFrame:
    """detail: as import_detail; module_of: path, module, or a rule (see with_module). One row per pair of different modules: weight, erased, n_files, files (that
    import, sorted), top_target and top_weight (an import counts one at least), pass_through, origin (the commonest of the files'
    and targets'), type_only. mode_: include, exclude or only type-only edges.

    What is summed for a target stands in windows by target beside each row, so that a pair of modules is grouped in one pass."""
    by = ["src", "dst"]
    rows = with_module(with_module(detail, "path", "src", module_of), "target", "dst", module_of).where("src <> dst")
    vote = Window.partitionBy(*by, "target", "origin")
    voted = F.when(F.col("origin").isNotNull() & (F.row_number().over(vote.orderBy("path")) == 1), F.struct(F.col("origin").alias("v"), F.count("*").over(vote).alias("n")))
    each = rows.withColumn("vote", voted).withColumn("w", F.sum(F.greatest("symbols", F.lit(1))).over(Window.partitionBy(*by, "target")))
    made = each.groupBy(*by).agg(
        F.sum("symbols").alias("weight"), F.sum("erased").alias("erased"), F.sort_array(F.collect_set("path")).alias("files"), F.min(F.struct((-F.col("w")).alias("w"), "target")).alias("top"),
        F.sum("pass_through").alias("pass_through"), most_frequent(F.collect_list("vote")).alias("origin"), F.bool_and("erasable").alias("type_only"),
    )
    out = made.select("src", "dst", "weight", "erased", F.size("files").alias("n_files"), "files", F.col("top.target").alias("top_target"), (-F.col("top.w")).alias("top_weight"), "pass_through", "origin", "type_only")
    return {"include": out, "exclude": out.where("not type_only"), "only": out.where("type_only")}[mode_]


def modules(module_of: DataFrame) -> DataFrame:
    """All modules, those without an edge included: node, files."""
    return module_of.groupBy(F.col("module").alias("node")).agg(F.count("*").alias("files"))


def dissolves(edges: DataFrame, module_of: DataFrame | Callable[[Column], Column], share: float = 0.8) -> DataFrame:
    """Edges that mostly forward what a third module has: at least ``share`` of the weight passes through, and the commonest origin is a
    file of another module than the edge's target. Adds origin_module; the heaviest first."""
    passing = edges.where((F.col("weight") > 0) & (F.col("pass_through") >= share * F.col("weight")) & F.col("origin").isNotNull())
    found = with_module(passing, "origin", "origin_module", module_of).where("origin_module <> dst")
    return found.orderBy(F.desc("weight"), "src", "dst")


def file_cycles(detail: DataFrame, module_of: DataFrame, components: DataFrame, search) -> DataFrame:
    """Cycles of files within each tangle (components: node, component, of modules): component, cycle (its first file), size, modules,
    crossing, members. All imports count, type-only ones too. search(edges, nodes): strongly connected components."""
    tangled = components.join(components.groupBy("component").agg(F.count("*").alias("size")).where("size > 1").select("component"), "component")
    of = module_of.join(tangled.select(F.col("node").alias("module"), "component"), "module")
    a, b = of.select("path", F.col("component").alias("a")), of.select(F.col("path").alias("target"), F.col("component").alias("b"))
    edges = detail.select("path", "target").where("path <> target").distinct().join(a, "path").join(b, "target").where("a = b").select(F.col("path").alias("src"), F.col("target").alias("dst"))
    found = search(edges, of.select(F.col("path").alias("node"))).join(of.withColumnRenamed("component", "tangle"), F.col("node") == F.col("path"))
    made = found.groupBy(F.col("tangle"), F.col("component").alias("cycle")).agg(F.count("*").alias("size"), F.count_distinct("module").alias("modules"), F.sort_array(F.collect_list("path")).alias("members"))
    return made.where("size > 1").select(F.col("tangle").alias("component"), "cycle", "size", "modules", (F.col("modules") > 1).alias("crossing"), "members")
