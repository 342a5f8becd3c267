"""What surrounds a cluster: shared imports, dependents, near variants, varying values, coverage gaps, diffs."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from weft.functions import text as X
from weft.functions.hashing import band_keys


def shared_imports(members: DataFrame, imports: DataFrame, ubiquity: float = 0.2) -> DataFrame:
    """members: cluster_id, file; imports: file, target. Targets that every file of a cluster of two or more imports, unless more than
    ``ubiquity`` of the other files import them too."""
    size = members.groupBy("cluster_id").agg(F.count_distinct("file").alias("n_files")).where("n_files >= 2")
    used = imports.select("file", "target").distinct()
    inside = members.distinct().join(used, "file").groupBy("cluster_id", "target").agg(F.count("*").alias("inside"))
    importers = used.groupBy("target").agg(F.count("*").alias("importers"))
    total = imports.agg(F.count_distinct("file").alias("all_files"))
    return (
        inside.join(size, "cluster_id").where("inside = n_files").join(importers, "target").crossJoin(F.broadcast(total))
        .withColumn("outside", F.col("importers") - F.col("inside"))
        .where(F.col("outside") <= ubiquity * (F.col("all_files") - F.col("n_files")))
        .select("cluster_id", "target", "n_files", "outside")
    )


def dependents(members: DataFrame, imports: DataFrame) -> DataFrame:
    """cluster_id, file of the distinct importers of a cluster's files that are not of it."""
    reached = members.join(imports.select(F.col("file").alias("importer"), F.col("target").alias("file")), "file").select("cluster_id", F.col("importer").alias("file")).distinct()
    return reached.join(members.select("cluster_id", "file"), ["cluster_id", "file"], "left_anti")


def barrel_dependents(members: DataFrame, imports: DataFrame, direct: DataFrame, forwarders: DataFrame) -> DataFrame:
    """cluster_id, file of the distinct importers of direct dependents that only forward (forwarders: path), which are neither of the
    cluster nor direct themselves."""
    barrels = direct.join(forwarders.select(F.col("path").alias("file")), "file", "left_semi")
    return dependents(barrels, imports).join(members.select("cluster_id", "file"), ["cluster_id", "file"], "left_anti").join(direct, ["cluster_id", "file"], "left_anti")


def near_variants(streams: DataFrame, similar: float = 0.6, most: int = 3, k: int = 5, words: Column | None = None) -> DataFrame:
    """streams: id, doc_id, start_at, end_at, words (of the findings that a report emits). Other findings of similar shingles that do not overlap, the best few.
    words: as for ``similar_pairs``, which finds them."""
    place = ["doc_id", "start_at", "end_at"]
    # similarities are rounded before they are compared
    pairs = similar_pairs(streams.drop(*place), similar - 5e-7, k, words=words).where(F.col("similarity") >= similar)
    for end in "uv":
        pairs = pairs.join(streams.select(F.col("id").alias(end), F.struct(*place).alias(f"at_{end}")), end)
    apart = pairs.where("not (at_u.doc_id = at_v.doc_id and at_u.start_at < at_v.end_at and at_v.start_at < at_u.end_at)")
    both = F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("variant")), F.struct(F.col("v").alias("id"), F.col("u").alias("variant")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "variant"))
    return apart.select(F.explode(both).alias("x"), "similarity").select("x.*", "similarity").withColumn("place", rank).where(F.col("place") <= most)


def lsh_pairs(streams: DataFrame, bands: int = 32, rows: int = 4, largest: int = 40, similar: float = 0.7, words: Column | None = None) -> DataFrame:
    """Pairs (u, v) of ids whose signatures agree in a band (of buckets of 2 to ``largest``, as the operator defines) and whose shingles are
    similar; ``similar_pairs`` is the exact way, without bands and buckets. words: as there.

    A stream is signed once and its bands move once: a bucket's size and each id's partners, the later ids of its bucket, are read where the bucket lies."""
    words = F.col("words") if words is None else words
    streams = streams.where(F.size(words) >= 5)
    hashed = streams.select("id", X.gram_hashes(words).alias("grams"))
    made = hashed.mapInArrow(partial(band_keys, bands=bands, rows=rows), StructType([hashed.schema["id"], StructField("keys", ArrayType(LongType()))]))
    bucket = Window.partitionBy("key")
    full = made.select("id", F.explode("keys").alias("key")).withColumn("n", F.count("*").over(bucket)).where(F.col("n").between(2, largest)).select("id", "key")
    later = F.collect_list("id").over(bucket.orderBy("id").rowsBetween(1, largest - 1))
    pairs = full.withColumn("later", later).select(F.col("id").alias("u"), F.explode("later").alias("v")).distinct()
    return _similar(pairs, streams, similar, 5, words)


def _similar(pairs: DataFrame, streams: DataFrame, similar: float, k: int, words: Column) -> DataFrame:
    """The pairs (u, v) of ids whose shingle sets have the similarity: u, v, similarity. Rows of streams move as they are."""
    for end in "uv":
        pairs = pairs.join(streams.withColumnRenamed("id", end), end).withColumn(f"words_{end}", words).drop(*(c for c in streams.columns if c != "id"))
    # both sets, and what they share, are elements of arrays, and the result is exploded, so that each is computed once
    sets = F.array(F.struct(*(X.shingle_hashes(F.col(f"words_{end}"), k).alias(end) for end in "uv")))
    found = F.filter(F.transform(sets, lambda x: X.jaccard(x["u"], x["v"])), lambda x: x >= similar)
    return pairs.select("u", "v", F.explode(found).alias("similarity")).withColumn("similarity", F.round("similarity", 6))


#: A shingle of so many streams or fewer is frequent for none of them: its streams are paired at once.
FEW = 256


def _bits(grams: Column, part: int) -> Column:
    """A bit for each shingle whose hash falls into the part (0 or 1) of 128 bits."""
    return F.aggregate(grams, F.lit(0).cast("long"), lambda acc, g: F.when(g.bitwiseAND(64) == 64 * part, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), g.bitwiseAND(63).cast("int")))).otherwise(acc))


def similar_pairs(streams: DataFrame, similar: float = 0.7, k: int = 5, few: int = FEW, words: Column | None = None) -> DataFrame:
    """All pairs (u, v) of ids whose shingle sets have the similarity: u, v, similarity. words: what makes the words of a row of ``streams``, where
    that is no column of it; rows move as they are.

    In any order of shingles, two such sets share one of their first n - ceil(similar * n) + 1. The order is that of the shingles' hashes;
    streams that share a shingle among their first, which no more than ``few`` have there, are paired at once, and so no stream has more
    than ``few`` partners by a shingle. What pairs share otherwise has more streams, and so all of a pair's streams are in the second way: there
    the order is by frequency, the rarest first. Both ways leave a pair out before it is written if its bits differ more often than the sets may."""
    words = F.col("words") if words is None else words
    grams = F.sort_array(X.shingle_hashes(words, k))
    streams = streams.where(F.size(words) >= k)
    most = F.col("n") - F.ceil(similar * F.col("n")) + 1
    sketch = [F.size("grams").alias("n"), *(_bits(F.col("grams"), part).alias(f"bits_{part}") for part in (0, 1))]
    names = ["id", "n", "bits_0", "bits_1"]
    first = streams.select("id", grams.alias("grams")).select("id", "grams", *sketch).select(*names, F.explode(F.slice("grams", F.lit(1), most.cast("int"))).alias("gram"))
    shared = first.withColumn("streams", F.count("*").over(Window.partitionBy("gram"))).where("streams > 1").checkpoint()

    def alike(a: str, b: str) -> Column:
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        differ = sum((F.bit_count(F.col(f"{a}.bits_{part}").bitwiseXOR(F.col(f"{b}.bits_{part}"))) for part in (0, 1)), F.lit(0))
        # of sets with the similarity s, the part that is not shared is (1 - s) / (1 + s) of both sizes at most; each bit that differs stands for one of it
        return (n >= similar * m) & (m >= similar * n) & (differ * (1 + similar) <= (1 - similar) * (n + m) + 1e-6)

    side = {s: shared.where(F.col("streams") <= few).select("gram", *names).alias(s) for s in "ab"}
    ends = [F.col("a.id").alias("u"), F.col("b.id").alias("v")]
    at_once = side["a"].join(side["b"], (F.col("a.gram") == F.col("b.gram")) & (F.col("a.id") < F.col("b.id")) & alike("a", "b")).select(*ends)
    left = shared.where(F.col("streams") > few).select("id").distinct().join(streams, "id").select("id", grams.alias("grams")).select("id", "grams", *sketch).checkpoint()
    each = left.select("id", F.explode("grams").alias("gram"))
    counted = each.join(each.groupBy("gram").agg(F.count("*").alias("df")), "gram")
    rarest = counted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("ranked")).join(left.select(*names), "id")
    rare = rarest.select(*names, F.explode(F.slice("ranked", F.lit(1), most.cast("int"))).alias("x")).select(*names, "x.gram")
    by_rare = rare.alias("a").join(rare.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.id") < F.col("b.id")) & alike("a", "b")).select(*ends)
    pairs = at_once.union(by_rare).distinct()
    return _similar(pairs, streams, similar, k, words)


def variations(copies: DataFrame) -> DataFrame:
    """copies: cluster_id, copy, words; of clusters whose copies have equally many. Positions where copies differ and all are literals, with the
    nearest identifier before that all share: cluster_id, at, label, distinct_values."""
    at = copies.select("cluster_id", "copy", F.posexplode("words").alias("at", "token"))
    made = at.groupBy("cluster_id", "at").agg(F.count_distinct("token").alias("distinct_values"), F.min("token").alias("token"), F.bool_or(~X.is_literal(F.col("token"))).alias("named"))
    name = F.when((F.col("distinct_values") == 1) & F.col("named"), F.col("token"))
    before = Window.partitionBy("cluster_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    labelled = made.withColumn("label", F.coalesce(F.last(name, ignorenulls=True).over(before), F.lit("an unnamed literal")))
    return labelled.where("distinct_values > 1 and not named").select("cluster_id", "at", "label", "distinct_values")


def field_drift(copies: DataFrame) -> DataFrame:
    """cluster_id, varying, total: identifier positions whose names differ among the copies, of all."""
    at = copies.select("cluster_id", F.posexplode("words").alias("at", "token"))
    made = at.groupBy("cluster_id", "at").agg(F.count_distinct("token").alias("names"), F.bool_and(~X.is_literal(F.col("token"))).alias("field"))
    return made.where("field").groupBy("cluster_id").agg(F.count_if(F.col("names") > 1).alias("varying"), F.count("*").alias("total"))


def coverage_gap(on_disk: DataFrame, analysed: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows of on_disk without analysis, by owner, the largest first."""
    return on_disk.join(analysed.select(key).distinct(), key, "left_anti").groupBy(owner).agg(F.count("*").alias("missing")).orderBy(F.desc("missing"), owner)


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """status of each id: resolved, added or unchanged."""
    b, a = before.select(key).distinct().withColumn("b", F.lit(True)), after.select(key).distinct().withColumn("a", F.lit(True))
    return b.join(a, key, "full_outer").select(key, F.when(F.col("a").isNull(), "resolved").when(F.col("b").isNull(), "added").otherwise("unchanged").alias("status"))


def percent_change(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.when(after == 0, 0.0).otherwise(100.0)).otherwise(F.round(100.0 * (after - before) / before, 4))


def budget_prefix(rows: DataFrame, cost: str, order: list[Column], budget: int) -> DataFrame:
    """The rows, in order, until one does not fit: where the running cost stays within the budget. Costs are whole numbers from 1 on, so no
    more rows than the budget can fit, and only so many are summed."""
    running = F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.orderBy(*order).limit(budget).withColumn("running_cost", running).where(F.col("running_cost") <= budget)
