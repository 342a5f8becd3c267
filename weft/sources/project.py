"""Projects on disk: configurations and their references, files, exclusions, what lies beside them.

A configuration is a JSON file with ``files``, ``include`` and ``exclude`` (globs below its folder) and ``references``. Configurations
are few and are read by the driver; files are read and filtered by Spark.
"""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as X
from weft.functions.globs import matches_any, regex_of

#: Endings of hand-written sources, and of those that are only declarations; fixed values.
ENDINGS = ("ts", "tsx", "mts", "cts")
DECLARATIONS = (".d.ts", ".d.mts", ".d.cts")
CONFIG = "tsconfig.json"
ROUNDS = 10


class EmptyProjectError(ValueError):
    """There is nothing to analyse; the report of an empty project would say that it is clean."""


@dataclass(frozen=True)
class Project:
    """root: the folder that paths are relative to; files: path, abs_path, content_hash, text of what is analysed; excluded: reason, n."""

    root: str
    configs: tuple[str, ...]
    files: DataFrame
    excluded: dict[str, int]
    on_disk: DataFrame


def common_root(paths: list[str]) -> str:
    """The folders that all paths' folders begin with."""
    if not paths:
        raise ValueError("no configuration is given")
    shared = posixpath.dirname(paths[0]).split("/")
    for p in paths[1:]:
        other = posixpath.dirname(p).split("/")
        n = next((k for k, (a, b) in enumerate(zip(shared, other, strict=False)) if a != b), min(len(shared), len(other)))
        shared = shared[:n]
    return "/".join(shared) or "/"


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def read_config(spark: SparkSession, path: str) -> dict:
    """The JSON of a configuration; comments and commas before a closing bracket are allowed."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*(?s:.*?)\*/', lambda m: m.group(1) or "", read_text(spark, path))
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", text))


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def referenced_config(config: str, reference: str) -> str:
    """The configuration that a reference names: a file, or a folder's."""
    path = posixpath.normpath(posixpath.join(posixpath.dirname(config), reference))
    return path if path.endswith(".json") else posixpath.join(path, CONFIG)


def expand_references(configs: list[str], has_files, references, rounds: int = ROUNDS) -> list[str]:
    """Configurations without files are replaced by what they refer to, for at most ``rounds`` rounds; each is visited once, whatever
    the case of its path. has_files(config), references(config) -> paths."""
    out, todo, seen = [], sorted(configs), {c.lower() for c in configs}
    for _ in range(rounds):
        more: list[str] = []
        for config in todo:
            if has_files(config):
                out.append(config)
                continue
            for r in references(config):
                path = referenced_config(config, r)
                if path.lower() not in seen:
                    seen.add(path.lower())
                    more.append(path)
        todo = sorted(more)
        if not todo:
            break
    return out


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """abs_path, content_hash and text of all files below the folder that end like sources; bytes that are no UTF-8 are replaced."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}").load(folder)
    plain = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    return found.select(plain.alias("abs_path"), F.md5("content").alias("content_hash"), F.decode("content", "UTF-8").alias("text"))


def _below(path: Column, folder: str) -> Column:
    """The path relative to a folder that it is in."""
    prefix = folder.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1)))


def project_files(spark: SparkSession, config: str) -> DataFrame:
    """The files that a configuration names, as ``list_files`` gives them."""
    folder, given = posixpath.dirname(config), read_config(spark, config)
    relative = _below(F.col("abs_path"), folder)
    named = [posixpath.normpath(f) for f in given.get("files", ())]
    globs = given.get("include", () if "files" in given else ("**/*",))
    wide = [g for g in globs for g in ([g] if "*" in g or re.search(r"\.\w+$", g) else [f"{g.rstrip('/')}/**/*"])]
    kept = (matches_any(relative, wide) | F.coalesce(relative.isin(named), F.lit(False))) & ~matches_any(relative, [g if "*" in g else f"{g.rstrip('/')}/**" for g in given.get("exclude", ())])
    return list_files(spark, folder).where(kept)


def one_per_path(frames: list[DataFrame]) -> DataFrame:
    """The union of projects' files: one row for each absolute path, whatever it holds."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["abs_path"])


def is_source(path: Column) -> Column:
    """Not a package's, a declaration or data."""
    out = ~path.contains("node_modules") & ~path.endswith(".json")
    for end in DECLARATIONS:
        out = out & ~path.endswith(end)
    return out


def drop_reason(path: Column, text: Column, include_generated: bool = False, banner_scan: bool = True, exclude: tuple[str, ...] = ()) -> Column:
    """Why a file is left out, by the first rule that says so (directory, pattern, banner), or null. Patterns count even where generated
    files are asked for."""
    out = F.lit(None).cast("string")
    if banner_scan and not include_generated:
        out = F.when(X.has_generated_banner(text), "banner").otherwise(out)
    if exclude:
        out = F.when(matches_any(path, exclude), "pattern").otherwise(out)
    if not include_generated:
        out = F.when(X.in_generated_directory(path), "directory").otherwise(out)
    return out


def disk_scan(files: DataFrame) -> DataFrame:
    """Of rows with a path, those that a person wrote: not below packages, dotted or generated folders, no declarations."""
    hidden = F.exists(X.directories(F.col("path")), lambda d: d.startswith(".") | (d == "node_modules"))
    return files.where(is_source(F.col("path")) & ~hidden & ~X.in_generated_directory(F.col("path")) & F.col("path").rlike(r"\.[cm]?tsx?$"))


def open_project(spark: SparkSession, configs: list[str], include_generated: bool = False, banner_scan: bool = True, exclude: tuple[str, ...] = ()) -> Project:
    """The union of the configurations' files without what is excluded. Raises EmptyProjectError if nothing is left."""
    plain = [re.sub("^file:/+", "/", posixpath.normpath(c)) for c in configs]
    root = common_root(plain)
    given = {}

    def config(path: str) -> dict:
        if path not in given:
            given[path] = read_config(spark, path) if exists(spark, path) else {}
        return given[path]

    def has_files(path: str) -> bool:
        return bool(config(path)) and (config(path).get("files") != [] or not config(path).get("references")) and not project_files(spark, path).isEmpty()

    leaves = expand_references(plain, has_files, lambda c: [r["path"] for r in config(c).get("references", ())])
    if not leaves:
        raise EmptyProjectError(f"no source files are found by {', '.join(plain)}")
    every = one_per_path([project_files(spark, c) for c in leaves]).withColumn("path", F.coalesce(_below(F.col("abs_path"), root), "abs_path")).where(is_source(F.col("path")))
    marked = every.withColumn("reason", drop_reason(F.col("path"), F.col("text"), include_generated, banner_scan, exclude))
    counts = {r["reason"]: r["n"] for r in marked.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    if not counts.get(None):
        raise EmptyProjectError(f"every source file of {', '.join(plain)} is excluded" if counts else f"no source files are found by {', '.join(plain)}")
    disk = disk_scan(list_files(spark, root).withColumn("path", _below(F.col("abs_path"), root))).select("path")
    return Project(root, tuple(leaves), marked.where("reason is null").drop("reason"), {k: n for k, n in counts.items() if k}, disk)


def owners(paths: DataFrame, configured: DataFrame) -> DataFrame:
    """path, owner: the nearest folder above that has a configuration (configured: folder), else the top folder, else a dot."""
    dirs = X.directories(F.col("path"))
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(dirs)), lambda k: F.array_join(F.slice(dirs, 1, k), "/"))).alias("folder"))
    nearest = above.join(configured.select("folder").distinct(), "folder").groupBy("path").agg(F.max(F.struct(F.length("folder").alias("n"), "folder")).alias("x")).select("path", F.col("x.folder").alias("nearest"))
    top = F.when(F.size(dirs) > 0, dirs[0]).otherwise(F.lit("."))
    named = F.when(F.col("nearest") == "", F.lit(".")).otherwise(F.col("nearest"))
    return paths.select("path").join(nearest, "path", "left").select("path", F.coalesce(named, top).alias("owner"))


def coverage(on_disk: DataFrame, analysed: DataFrame, configured: DataFrame) -> tuple[DataFrame, bool]:
    """owner, missing for files on disk that are not analysed, the most first; and whether none is missing."""
    missing = on_disk.select("path").join(analysed.select("path"), "path", "left_anti")
    gaps = owners(missing, configured).groupBy("owner").agg(F.count("*").alias("missing")).orderBy(F.desc("missing"), "owner")
    return gaps, missing.isEmpty()


def pattern_of(glob: str) -> str:
    """The regular expression of a caller's glob, for SQL."""
    return regex_of(glob)
