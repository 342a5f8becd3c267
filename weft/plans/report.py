"""The report over a project: duplication, types, tangles and what surrounds them.

Everything that grows with the project is a DataFrame; what is collected is totals and the findings that are shown, with a bounded
sample of their copies. Modules of tangles are collected up to MOST_MODULES each, as no cut is searched for beyond.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import text as X
from weft.functions.hashing import hash_of
from weft.operators import clusters as C
from weft.operators import context as K
from weft.operators import graph as G
from weft.operators import imports as I
from weft.operators import variation as V
from weft.plans import markdown
from weft.plans.options import VERSION, Options
from weft.sources import code
from weft.sources.project import EmptyProjectError, Project, coverage, open_project
from weft.streaming.incremental import Cache

#: What is listed of each at most.
LISTED = {"variants": 3, "shared_imports": 3, "barrels": 2, "gaps": 5, "cut_files": 3, "dissolves": 4, "file_cycles": 4, "chart_modules": 20, "chart_edges": 120}


@dataclass(frozen=True)
class Report:
    json: dict
    markdown: str


def checkpoint_folder(spark: SparkSession) -> None:
    """The shared folder that the session names; a temporary one only where none is named and all runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-checkpoint-"))


def fragments_of(spark: SparkSession, project: Project, options: Options, cache_folder: str | None) -> DataFrame:
    """Shaped fragments of all files, from the cache where it has them. The cache's configuration is the floors, which decide the rows."""

    def derive(files: DataFrame) -> DataFrame:
        shaped = code.shaped_fragments(files, options.min_nodes, options.min_lines)
        # a file without a fragment is known too
        return files.select("path", "content_hash").join(shaped, "path", "left")

    if cache_folder and options.cache:
        rows = Cache(spark, cache_folder, hash_of(f"{options.min_nodes} {options.min_lines}")[:8]).refresh(project.files, derive)
    else:
        rows = derive(project.files)
    return rows.where("l0 is not null").checkpoint()


def clusters_of(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters of both levels with their kind, and their copies: cluster_id, level, doc_id (path), source (module), seq, start_at, end_at, line, end_line, parent."""
    rows = fragments.select(
        F.col("path").alias("doc_id"), F.col("module").alias("source"), "seq", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"),
        F.col("node_count").alias("n_words"), "kind", "line", "end_line", F.col("parent_id").alias("parent"), "literal_share", "l0", "l1",
    )
    both, copies = [], []
    for level in ("L0", "L1"):
        of = rows.where(F.col("literal_share") < C.LITERAL_LIMIT) if level == "L1" else rows
        made = C.groups(rows, level)
        own = C.occurrences(of, made, level).withColumn("level", F.lit(level))
        copies.append(own.select("cluster_id", "level", "doc_id", "source", "seq", "start_at", "end_at", "n_words", "kind", "line", "end_line", "parent"))
        both.append(made)
    held = copies[0].union(copies[1]).checkpoint()
    kinds = held.groupBy("cluster_id").agg(F.min(F.struct("doc_id", "start_at", "end_at", "seq", "kind"))["kind"].alias("kind"))
    return both[0].union(both[1]).join(kinds, "cluster_id").checkpoint(), held


def ranked(clusters: DataFrame, copies: DataFrame) -> DataFrame:
    """Scores of kept clusters, with id, level, kind, node_count, mass and section."""
    lines, test = F.col("end_line") - F.col("line") + 1, X.is_test_path(F.col("doc_id"))
    own = copies.join(clusters.select("cluster_id"), "cluster_id", "left_semi")
    scores = C.scored(own.where("level = 'L0'"), test, lines, "L0").union(C.scored(own.where("level = 'L1'"), test, lines, "L1"))
    types = F.col("kind").isin(sorted(code.TYPE_KINDS))
    section = F.when(C.section() == "test", "tests").when(types, "types").otherwise("code")
    return scores.join(clusters.select("cluster_id", "level", "kind", "node_count", "mass"), "cluster_id").withColumn("section", section).withColumn("id", X.finding_id("DUP", F.col("cluster_id")))


def streams_of(findings: DataFrame, copies: DataFrame, files: DataFrame, options: Options) -> dict[str, list[list[str]]]:
    """L1 streams of the first copies of each finding: what was emitted first at the copy's range."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("doc_id", "start_at", "end_at", "seq"))
    some = copies.join(findings.select("cluster_id"), "cluster_id", "left_semi").withColumn("place", place).where(F.col("place") <= V.MOST_COPIES).select("cluster_id", "place", F.col("doc_id").alias("path"), "start_at", "end_at")
    read = code.fragments(files.join(some.select("path").distinct(), "path", "left_semi"), options.min_nodes, options.min_lines)
    first = F.min(F.struct("seq", "tokens_l0"))["tokens_l0"].alias("tokens")
    found = some.join(read, (some["path"] == read["path"]) & (F.col("start_at") == F.col("start")) & (F.col("end_at") == F.col("end"))).groupBy("cluster_id", "place").agg(first)
    out: dict[str, list[list[str]]] = {}
    for r in found.orderBy("cluster_id", "place").collect():
        out.setdefault(r["cluster_id"], []).append(r["tokens"])
    return out


def shown(spark: SparkSession, scores: DataFrame, section: str, copies: DataFrame, files: DataFrame, options: Options) -> tuple[DataFrame, dict[str, list[list[str]]]]:
    """The best findings of a section, after those that may be among them were weighed by how their fields' names differ."""
    slots = options.cap(section)
    rows = scores.where(F.col("section") == section)
    pool = rows.orderBy(F.desc("score"), "cluster_id").limit(3 * slots).checkpoint()
    streams = streams_of(pool, copies, files, options)
    drifts = [(c, *V.field_drift(s)) for c, s in streams.items()]
    drift = spark.createDataFrame(drifts, "cluster_id string, varying int, total int")
    return C.rerank(pool, drift, slots).checkpoint(), streams


def tangles(edges: DataFrame, module_of: DataFrame, detail: DataFrame, options: Options) -> tuple[list[dict], DataFrame]:
    """A finding for each strongly connected component of two modules or more, by its first module; and all components."""
    nodes = I.modules(module_of)
    components = G.strong_components(edges, nodes).checkpoint()
    sizes = G.component_sizes(components)
    wanted = sizes.orderBy("component").limit(options.max_findings).checkpoint()
    members: dict[str, list[str]] = {}
    for r in components.join(wanted.select("component"), "component", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("component").orderBy("node"))).where(F.col("place") <= 2 * G.MOST_MODULES).orderBy("component", "node").collect():
        members.setdefault(r["component"], []).append(r["node"])
    size = {r["component"]: r["size"] for r in wanted.collect()}
    small = wanted.where(F.col("size") <= G.MOST_MODULES).select("component")
    inner = G.inner_edges(edges, components).join(small, "component", "left_semi").checkpoint()
    rows: dict[str, list[dict]] = {}
    for r in inner.select("component", "src", "dst", "weight", "erased", "n_files", F.slice("files", 1, LISTED["cut_files"]).alias("files"), "top_target", "pass_through", "origin", "type_only").orderBy("component", "src", "dst").collect():
        rows.setdefault(r["component"], []).append(r.asDict())
    dissolving: dict[str, list[dict]] = {}
    for r in I.dissolves(inner, module_of).select("component", "src", "dst", "weight", "pass_through", "origin", "origin_module").collect():
        dissolving.setdefault(r["component"], []).append(r.asDict())
    cycles: dict[str, list[dict]] = {}
    found = I.file_cycles(detail, module_of, components, G.strong_components).join(wanted.select("component"), "component", "left_semi")
    for r in found.select("component", "cycle", "size", "modules", "crossing", F.slice("members", 1, 8).alias("members")).orderBy(F.desc("size"), "cycle").collect():
        cycles.setdefault(r["component"], []).append(r.asDict())
    out = []
    for c in sorted(members):
        own, of_files = rows.get(c, []), cycles.get(c, [])
        crossing = [x for x in of_files if x["crossing"]]
        gone = dissolving.get(c, [])
        found_cut = G.cut_search(members[c], own, {(e["src"], e["dst"]) for e in gone}, bool(crossing))
        runtime = G.largest_component(members[c], [(e["src"], e["dst"]) for e in own if not e["type_only"]])
        out.append({
            "id": f"CYC-{hash_of(' '.join(members[c]))[:8]}", "members": members[c], "size": size[c], "edges": own[: LISTED["chart_edges"]], "runtime_size": runtime if runtime > 1 else 0,
            "file_cycles": {"crossing": len(crossing), "within": len(of_files) - len(crossing), "examples": of_files[: LISTED["file_cycles"]]},
            "dissolves": gone[: LISTED["dissolves"]], "cut": found_cut["cut"], "residual": found_cut["residual"], "rejected": found_cut["rejected"],
        })
    return out, components


def surroundings(findings: DataFrame, copies: DataFrame, detail: DataFrame, forwarders: DataFrame) -> dict[str, dict]:
    """Of each finding: imports that all its files share, how many files depend on it, and how many more through files that only forward."""
    members = copies.join(findings.select("cluster_id"), "cluster_id", "left_semi").select("cluster_id", F.col("doc_id").alias("file")).distinct().checkpoint()
    uses = detail.select(F.col("path").alias("file"), "target").distinct()
    out: dict[str, dict] = {}

    def of(cluster: str) -> dict:
        return out.setdefault(cluster, {"shared_imports": [], "dependents": 0, "barrel_dependents": 0, "barrels": []})

    for r in K.shared_imports(members, uses).orderBy("cluster_id", "outside", "target").collect():
        of(r["cluster_id"])["shared_imports"].append({"target": r["target"], "outside": r["outside"]})
    direct = K.dependents(members, uses).checkpoint()
    for r in direct.groupBy("cluster_id").agg(F.count("*").alias("n")).collect():
        of(r["cluster_id"])["dependents"] = r["n"]
    barrels = direct.join(forwarders.withColumnRenamed("path", "file"), "file", "left_semi")
    for r in barrels.groupBy("cluster_id").agg(F.slice(F.sort_array(F.collect_set("file")), 1, LISTED["barrels"]).alias("files")).collect():
        of(r["cluster_id"])["barrels"] = r["files"]
    for r in K.barrel_dependents(members, uses, direct, forwarders).groupBy("cluster_id").agg(F.count("*").alias("n")).collect():
        of(r["cluster_id"])["barrel_dependents"] = r["n"]
    for x in out.values():
        x["shared_imports"] = x["shared_imports"][: LISTED["shared_imports"]]
    return out


def excerpts(findings: DataFrame, copies: DataFrame, files: DataFrame) -> dict[str, str]:
    """The first lines of the first copy of each finding, more of them for longer ones."""
    first = copies.join(findings.select("cluster_id", "lines_per_copy"), "cluster_id").groupBy("cluster_id", "lines_per_copy").agg(F.min(F.struct("doc_id", "start_at", "end_at")).alias("x"))
    rows = first.select("cluster_id", "lines_per_copy", F.col("x.doc_id").alias("path"), "x.start_at", "x.end_at").join(files.select("path", "text"), "path")
    lines = F.greatest(F.lit(3), F.least(F.lit(10), F.round(0.6 * F.col("lines_per_copy")).cast("int")))
    cut = F.substr(F.col("text"), (F.col("start_at") + 1).cast("int"), (F.col("end_at") - F.col("start_at")).cast("int"))
    return {r["cluster_id"]: r["excerpt"] for r in rows.select("cluster_id", X.excerpt(cut, lines).alias("excerpt")).collect()}


def finding_rows(section: str, findings: DataFrame, streams: dict, copies: DataFrame, extra: dict) -> list[dict]:
    """The findings of a section as they go into the report, in order."""
    at: dict[str, list[dict]] = {}
    own = copies.join(findings.select("cluster_id"), "cluster_id", "left_semi").groupBy("cluster_id", "doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    for r in own.orderBy("cluster_id", "doc_id").collect():
        at.setdefault(r["cluster_id"], []).append({"path": r["doc_id"], "lines": r["lines"]})
    out = []
    for r in findings.orderBy(F.desc("score"), "cluster_id").collect():
        c = r["cluster_id"]
        row = {k: r[k] for k in ("id", "level", "copies", "files", "modules", "node_count", "lines_per_copy", "recoverable_lines", "score", "tag")}
        row |= {"kind": code.canonical_kind(r["kind"]), "section": section, "locations": at.get(c, [])}
        found = V.variations(streams.get(c, []), r["copies"])
        row |= {"variations": [{"label": v.label, "values": v.values, "saturated": v.saturated} for v in found]} if found else {}
        out.append(row | {k: v[c] for k, v in extra.items() if v.get(c)})
    return out


def near(findings: list[DataFrame], streams: dict, copies: DataFrame, spark: SparkSession) -> dict[str, list[dict]]:
    """Other findings of similar streams, by finding."""
    emitted = findings[0].select("cluster_id", "id")
    for f in findings[1:]:
        emitted = emitted.union(f.select("cluster_id", "id"))
    first = copies.groupBy("cluster_id").agg(F.min(F.struct("doc_id", "start_at", "end_at")).alias("x"))
    tokens = spark.createDataFrame([(c, s[0]) for c, s in streams.items() if s], "cluster_id string, words array<string>")
    rows = emitted.join(first, "cluster_id").join(tokens, "cluster_id").select("cluster_id", F.col("id"), "x.doc_id", "x.start_at", "x.end_at", "words")
    back = {r["id"]: r["cluster_id"] for r in emitted.collect()}
    out: dict[str, list[dict]] = {}
    for r in K.near_variants(rows, most=LISTED["variants"]).orderBy("id", "place").collect():
        out.setdefault(back[r["id"]], []).append({"id": r["variant"], "similarity": r["similarity"]})
    return out


def report(spark: SparkSession, project: Project, options: Options = Options(), cache_folder: str | None = None) -> Report:
    """The report as JSON and Markdown. Raises EmptyProjectError where there is nothing to report on."""
    checkpoint_folder(spark)
    files = project.files.checkpoint()
    if files.isEmpty():
        raise EmptyProjectError("the project has no source files")
    paths = files.select("path")
    module_of, label = G.modules_of(paths, options.granularity)
    module_of = module_of.checkpoint()
    totals = files.agg(F.count("*").alias("files"), F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.sum(F.length("text")).alias("chars")).first()

    bindings = I.resolve(code.import_bindings(files), paths).checkpoint()
    detail = I.import_detail(I.with_origins(bindings)).checkpoint()
    edges = I.module_graph(detail, module_of, options.types).checkpoint()
    cycles, components = tangles(edges, module_of, detail, options)
    reach = G.closure(edges)
    cost = G.propagation_cost(reach, I.modules(module_of)).first()
    largest = G.component_sizes(components).agg(F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.count("*").alias("n")).first()

    fragments = fragments_of(spark, project, options, cache_folder).join(module_of, "path")
    clusters, copies = clusters_of(fragments)
    pairs = C.containment(copies, copies).checkpoint()
    kept = C.subsume(pairs, clusters).checkpoint()
    scores = ranked(kept, copies).checkpoint()
    covered = C.covered(C.redundant(copies.join(kept.select("cluster_id"), "cluster_id", "left_semi"))).agg(F.coalesce(F.sum("covered"), F.lit(0)).alias("n")).first()["n"]
    mass = scores.agg(F.coalesce(F.sum("mass"), F.lit(0)).alias("mass"), F.count("*").alias("n"), F.count_if(F.col("files") == 1).alias("single")).first()
    bands = {r["band"]: r["clusters"] for r in C.census(scores, F.when(F.col("section") == "code", "production")).collect()}
    sections = {r["section"]: r["n"] for r in scores.groupBy("section").agg(F.count("*").alias("n")).collect()}

    wanted = [s for s in ("code", "types", "tests") if not (s == "types" and options.types == "exclude") and not (s == "code" and options.types == "only")]
    frames, streams = {}, {}
    for section in wanted:
        frames[section], found = shown(spark, scores, section, copies, files, options)
        streams |= found
    every = None
    for f in frames.values():
        every = f if every is None else every.union(f)
    others: dict[str, list[dict]] = {}
    elsewhere = C.also_at(pairs, clusters, kept, copies).join(every.select("cluster_id"), "cluster_id", "left_semi")
    for r in elsewhere.orderBy("cluster_id", "place").collect():
        others.setdefault(r["cluster_id"], []).append({"path": r["path"], "line": r["line"]})
    extra = {"context": surroundings(every, copies, detail, I.pure_forwarders(bindings)), "also_at": others, "variants": near(list(frames.values()), streams, copies, spark), "excerpt": excerpts(every, copies, files)}
    rows = {s: finding_rows(s, frames[s], streams, copies, extra) for s in wanted}

    configured = spark.createDataFrame([(c[len(project.root) :].strip("/").rpartition("/")[0],) for c in project.configs], "folder string")
    gaps, complete = coverage(project.on_disk, paths, configured)
    out = {
        "version": VERSION, "config_hash": options.config_hash(), "granularity": label,
        "scope": {"files": totals["files"], "on_disk": project.on_disk.count(), "complete": complete, "gaps": [r.asDict() for r in gaps.limit(LISTED["gaps"]).collect()]},
        "excluded": project.excluded,
        "metrics": {
            "files": totals["files"], "lines": totals["lines"], "chars": totals["chars"], "modules": cost["modules"], "duplicated_mass": mass["mass"],
            "redundant_fraction": round(min(1.0, covered / totals["chars"]), 6) if totals["chars"] else 0.0, "propagation_cost": cost["cost"], "cycle_count": largest["n"], "largest_scc": largest["largest"], "findings": mass["n"],
        },
        "census": {"sections": sections, "bands": bands, "single_file": mass["single"]},
        "duplication": rows.get("code", []) + rows.get("tests", []), "types": rows.get("types", []), "cycles": cycles,
    }
    return Report(out, markdown.render(out, options))


class Engine:
    """The library's front: a session, and reports on projects."""

    def __init__(self, spark: SparkSession, cache_folder: str | None = None) -> None:
        self.spark, self.cache_folder = spark, cache_folder

    def open(self, configs: list[str], options: Options = Options()) -> Project:
        return open_project(self.spark, configs, options.include_generated, options.banner_scan, options.exclude)

    def report(self, configs: list[str], options: Options = Options()) -> Report:
        return report(self.spark, self.open(configs, options), options, self.cache_folder)
