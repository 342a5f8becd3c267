"""Clone clusters: grouping, suppression, coverage, score, sections and census.

Fragments need doc_id, source, start_at, end_at, seq, n_words, l0, l1 and literal_share. Grouping aggregates before it shuffles, and no list of a
cluster's copies is built: what needs the copies joins them back by the cluster's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Constants of the score. Pinned: the copies that count for each file, spread and test weights. The rest is inferred.
COPIES_PER_FILE = 10
SPREAD = {"module": 2.5, "file": 1.4, "one": 0.8}
LEVEL_WEIGHT = {"L0": 1.0, "L1": 0.9}
TEST_WEIGHT, PARENT_WEIGHT = 0.4, 0.2
LITERAL_LIMIT = 0.35


def groups(fragments: DataFrame, level: str = "L0") -> DataFrame:
    """cluster_id, level, copies, files, modules, node_count, mass. At L1, rows rich in literals are left out and so are groups that
    are one group at L0."""
    rows = fragments.where(F.col("literal_share") < LITERAL_LIMIT) if level == "L1" else fragments
    made = rows.groupBy(F.col(level.lower()).alias("cluster_id")).agg(
        F.count("*").alias("copies"), F.count_distinct("doc_id").alias("files"), F.count_distinct("source").alias("modules"),
        F.min("n_words").cast("long").alias("node_count"), F.min("l0").alias("low"), F.max("l0").alias("high"),
    )
    kept = made.where("copies > 1" if level == "L0" else "copies > 1 and low <> high")
    return kept.select("cluster_id", F.lit(level).alias("level"), "copies", "files", "modules", "node_count", (F.col("node_count") * (F.col("copies") - 1)).alias("mass"))


def suppressed(fragments: DataFrame) -> DataFrame:
    """L1 groups that are one group at L0."""
    rows = fragments.where(F.col("literal_share") < LITERAL_LIMIT)
    made = rows.groupBy(F.col("l1").alias("cluster_id")).agg(F.count("*").alias("copies"), F.min("l0").alias("l0"), F.max("l0").alias("high"))
    return made.where("copies > 1 and l0 = high").select("cluster_id", "l0", "copies")


def occurrences(fragments: DataFrame, clusters: DataFrame, level: str = "L0") -> DataFrame:
    return fragments.withColumnRenamed(level.lower(), "cluster_id").join(clusters.select("cluster_id"), "cluster_id")


def top(clusters: DataFrame, k: int = 40, by: str = "mass") -> DataFrame:
    return clusters.orderBy(F.desc(by), "cluster_id").limit(k)


def redundant(copies: DataFrame) -> DataFrame:
    """All but the first copy of each cluster, in the order of document and range: what is not the smallest one."""
    first = copies.groupBy("cluster_id").agg(F.min(F.struct("doc_id", "start_at", "end_at", "seq")).alias("first"))
    return copies.join(first, "cluster_id").where(F.struct("doc_id", "start_at", "end_at", "seq") != F.col("first")).drop("first")


def covered(ranges: DataFrame, within: str = "doc_id") -> DataFrame:
    """Length of the union of the ranges of each ``within``: a sweep over sorted ranges with a running maximum of ends."""
    before = Window.partitionBy(within).orderBy("start_at", "end_at").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end_at") - F.greatest("start_at", F.coalesce(F.max("end_at").over(before), F.col("start_at"))))
    return ranges.select(within, "start_at", "end_at").distinct().withColumn("new", new).groupBy(within).agg(F.sum("new").alias("covered"))


def recoverable(copies: Column, lines: Column) -> Column:
    return F.greatest(F.lit(0), (copies - 1) * (lines - 1) - 2)


def scored(copies: DataFrame, is_test: Column, lines: Column, level: str = "L0") -> DataFrame:
    """Score and tag of each cluster. ``lines``: lines of a copy; parents are (document, parent)."""
    rows = copies.select("cluster_id", "doc_id", "source", is_test.alias("is_test"), lines.alias("lines"), F.col("parent") if "parent" in copies.columns else F.col("doc_id").alias("parent"))
    # one row for each parent and number of lines first, so that no distinct count multiplies the copies and the median weighs counts
    each = rows.groupBy("cluster_id", "doc_id", "source", "parent", "lines").agg(F.count("*").alias("n"), F.count_if(F.col("is_test")).alias("tests"))
    by_parent = each.groupBy("cluster_id", "doc_id", "source", "parent").agg(F.sum("n").alias("n"), F.sum("tests").alias("tests"))
    by_file = by_parent.groupBy("cluster_id", "doc_id", "source").agg(F.sum("n").alias("n"), F.sum("tests").alias("tests"), F.count("*").alias("parents"))
    by_module = by_file.groupBy("cluster_id", "source").agg(F.sum("n").alias("n"), F.sum("tests").alias("tests"), F.sum("parents").alias("parents"), F.count("*").alias("files"))
    totals = by_module.groupBy("cluster_id").agg(F.sum("n").alias("copies"), F.sum("files").alias("files"), F.count("source").alias("modules"), F.sum("tests").alias("tests"), F.sum("parents").alias("parents"))
    spans = each.groupBy("cluster_id", "lines").agg(F.sum("n").alias("n")).groupBy("cluster_id").agg(F.percentile("lines", 0.5, F.col("n")).alias("lines_per_copy"))
    made = totals.join(spans, "cluster_id")
    spread = F.when(F.col("modules") > 1, SPREAD["module"]).when(F.col("files") > 1, SPREAD["file"]).otherwise(SPREAD["one"])
    share = 1 - F.col("tests") / F.col("copies")
    score = (
        recoverable(F.least("copies", COPIES_PER_FILE * F.col("files")), F.col("lines_per_copy"))
        * spread * LEVEL_WEIGHT[level] * (TEST_WEIGHT + (1 - TEST_WEIGHT) * share) * (PARENT_WEIGHT + (1 - PARENT_WEIGHT) * F.col("parents") / F.col("copies"))
    )
    tag = F.when(F.col("tests") == 0, "source").when(F.col("tests") == F.col("copies"), "test").otherwise("mixed")
    return made.select("cluster_id", "copies", "files", "modules", "tests", "parents", "lines_per_copy", recoverable(F.col("copies"), F.col("lines_per_copy")).alias("recoverable_lines"), F.round(score, 4).alias("score"), tag.alias("tag"))


def drift_weight(varying: Column, total: Column) -> Column:
    return F.when(total > 0, 1 - 0.75 * varying / total).otherwise(F.lit(1.0))


def rerank(scores: DataFrame, drift: DataFrame, slots: int, pool: int = 3) -> DataFrame:
    """The best ``slots`` after the best ``pool * slots`` by score were weighed by their drift (cluster_id, varying, total)."""
    some = scores.orderBy(F.desc("score"), "cluster_id").limit(pool * slots)
    weighed = some.join(drift, "cluster_id", "left").withColumn("score", F.round(F.col("score") * drift_weight(F.coalesce("varying", F.lit(0)), F.coalesce("total", F.lit(0))), 4))
    return weighed.orderBy(F.desc("score"), "cluster_id").limit(slots).drop("varying", "total")


def section() -> Column:
    """Test if half of the copies or more are; else production."""
    return F.when(2 * F.col("tests") >= F.col("copies"), "test").otherwise("production")


def band(lines: Column) -> Column:
    """The bands of the census."""
    return F.when(lines >= 100, "100+").when(lines >= 30, "30-99").when(lines >= 10, "10-29").when(lines >= 4, "4-9").when(lines >= 1, "1-3").otherwise("0")


def census(scores: DataFrame, of: Column | None = None) -> DataFrame:
    """Clusters of production code by band of recoverable lines; ``of``: the section of each cluster, where there are more than two."""
    return scores.where((section() if of is None else of) == "production").groupBy(band(F.col("recoverable_lines")).alias("band")).agg(F.count("*").alias("clusters"))


#: Characters of a cell of the grid on which ranges meet.
CELL = 2048


def containment(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """For clusters that hold copies of others (same document, range within): outer_id, inner_id, contained, of. Ranges meet in the
    cell where the inner one starts, so a document's ranges are not all paired."""
    cells = F.sequence(F.floor(F.col("start_at") / CELL), F.floor(F.greatest(F.col("start_at"), F.col("end_at")) / CELL))
    o = outer.select("doc_id", F.col("cluster_id").alias("outer_id"), F.col("start_at").alias("o_start"), F.col("end_at").alias("o_end"), F.explode(cells).alias("cell"))
    i = inner.select("doc_id", F.col("cluster_id").alias("inner_id"), "start_at", "end_at", "seq", F.floor(F.col("start_at") / CELL).alias("cell"))
    held = o.join(i, ["doc_id", "cell"]).where("o_start <= start_at and end_at <= o_end and outer_id <> inner_id")
    total = inner.groupBy(F.col("cluster_id").alias("inner_id")).agg(F.count("*").alias("of"))
    return held.groupBy("outer_id", "inner_id").agg(F.count_distinct("doc_id", "start_at", "end_at", "seq").alias("contained")).join(total, "inner_id").select("outer_id", "inner_id", "contained", "of")


def holders(pairs: DataFrame, clusters: DataFrame, share: float = 0.8) -> DataFrame:
    """outer_id, inner_id for clusters that hold enough of a smaller one to swallow it; an L1 cluster never swallows an L0 one."""
    c = clusters.select("cluster_id", "level", "node_count")
    o, i = c.alias("o"), c.alias("i")
    return (
        pairs.where(F.col("contained") >= share * F.col("of"))
        .join(o, F.col("outer_id") == F.col("o.cluster_id")).join(i, F.col("inner_id") == F.col("i.cluster_id"))
        .where("not (i.level = 'L0' and o.level = 'L1')")
        .where("o.node_count > i.node_count or (o.node_count = i.node_count and outer_id < inner_id)")
        .select("outer_id", "inner_id")
    )


def subsume(pairs: DataFrame, clusters: DataFrame, share: float = 0.8) -> DataFrame:
    """Clusters that no kept larger one holds by ``share``. Rounds settle those clusters whose possible holders are all settled,
    largest first, until none is open."""
    over = holders(pairs, clusters, share).checkpoint()
    state = clusters.select("cluster_id", F.lit(None).cast("boolean").alias("kept"))
    while True:
        seen = over.join(state, F.col("outer_id") == F.col("cluster_id")).groupBy("inner_id").agg(F.max("kept").alias("held"), F.count_if(F.col("kept").isNull()).alias("open"))
        state = state.join(seen, F.col("cluster_id") == F.col("inner_id"), "left").select(
            "cluster_id", F.coalesce("kept", F.when(F.col("held"), False).when(F.coalesce("open", F.lit(0)) == 0, True)).alias("kept"),
        ).checkpoint()
        if state.where("kept is null").isEmpty():
            return clusters.join(state.where("kept").select("cluster_id"), "cluster_id", "left_semi")


def also_at(pairs: DataFrame, clusters: DataFrame, kept: DataFrame, copies: DataFrame, path: str = "doc_id", line: str = "line", share: float = 0.8) -> DataFrame:
    """cluster_id, path, line, place: where else parts of a kept cluster stand. Of each swallowed cluster, its largest kept holder gains, if
    their levels are equal, the copies outside its own: one for each file, at the earliest line, shallow paths first."""
    level = clusters.select("cluster_id", "level", "node_count")
    over = holders(pairs, clusters, share).join(kept.select(F.col("cluster_id").alias("outer_id")), "outer_id", "left_semi").join(kept.select(F.col("cluster_id").alias("inner_id")), "inner_id", "left_anti")
    first = F.min(F.struct((-F.col("node_count")).alias("n"), F.col("outer_id").alias("id")))
    chosen = over.join(level.withColumnRenamed("cluster_id", "outer_id"), "outer_id").groupBy("inner_id").agg(first.alias("x")).select("inner_id", F.col("x.id").alias("outer_id"))
    same = chosen.join(level.select(F.col("cluster_id").alias("inner_id"), F.col("level").alias("a")), "inner_id").join(level.select(F.col("cluster_id").alias("outer_id"), F.col("level").alias("b")), "outer_id").where("a = b").select("inner_id", "outer_id")
    rows = copies.select(F.col("cluster_id").alias("inner_id"), "doc_id", "start_at", "end_at", F.col(path).alias("path"), F.col(line).alias("line")).join(same, "inner_id")
    own = copies.select(F.col("cluster_id").alias("outer_id"), "doc_id", F.col("start_at").alias("o_start"), F.col("end_at").alias("o_end"))
    outside = rows.join(own, (rows["outer_id"] == own["outer_id"]) & (rows["doc_id"] == own["doc_id"]) & (F.col("o_start") <= F.col("start_at")) & (F.col("end_at") <= F.col("o_end")), "left_anti")
    each = outside.groupBy(F.col("outer_id").alias("cluster_id"), "path").agg(F.min("line").alias("line"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.size(F.split("path", "/")), "path"))
    return each.select("cluster_id", "path", "line", place.alias("place"))
