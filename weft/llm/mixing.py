"""Mixing sources to target weights over a time-varying curriculum, with DataFrame operations only.

Each source has a weight and a schedule, a piecewise linear multiplier over training time 0..1. Targets share all words by
the integrated weights, at most ``most_epochs`` times a source's words, the excess reshared by weight until none is above. A source's cumulative demand is its target times
the integral of its schedule; inverting it at the words that stand before a document gives the document's training
position, of its first use and, a lap over the source later, of each further one. Documents are range-sorted by position.

Within a source, documents stand in the order of a hash. Words before a document are summed in two levels, over hash buckets
and within one, so that a source with any share of all rows is spread over all tasks.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own and stands last;
with no words at all every target is 0; repeated rows are documents of their own, and identical ones share what they are taken;
of other columns none is read, so their names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import cut
from weft.llm.sharding import ranked

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of each source's documents.
BUCKETS = 4096
MOST_EPOCHS = 3
#: Knots (time, multiplier) of the schedules, dealt to the sources in turn: steady, falling, rising.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.4), (0.3, 0.4), (0.7, 1.6), (1.0, 1.6)))


def segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float]]:
    """(time, multiplier, slope, integral so far) at the start of each segment, integrals scaled to 1 in all."""
    out, area = [], 0.0
    for (t0, m0), (t1, m1) in zip(knots, knots[1:], strict=False):
        out.append((t0, m0, (m1 - m0) / (t1 - t0), area))
        area += (m0 + m1) / 2 * (t1 - t0)
    return [(t, m / area, s / area, a / area) for t, m, s, a in out]


def position(fraction: Column, schedule: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time at which a source has asked for this fraction of its target; beyond 1 for what it never asks for."""
    out = None
    for k, knots in enumerate(schedules):
        one = None
        for t, m, s, a in reversed(segments(knots)):
            left = fraction - a
            # t + x with m x + s x^2 / 2 = left, in the form that stands for any slope
            at = t + 2 * left / (m + F.sqrt(F.greatest(F.lit(0.0), F.lit(m * m) + 2 * s * left)))
            one = at if one is None else F.when(fraction < following, at).otherwise(one)
            following = a
        one = F.when(fraction >= 1, fraction).otherwise(one)
        out = F.when(schedule == k, one) if out is None else out.when(schedule == k, one)
    return out


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """Adds rank, schedule, weight and target to one row per source with its source_size. The rank comes from a range sort; the level
    to which sources fill is found in a few rounds of sums, each of which takes those that it fills out of the next."""
    placed = ranked(sources.withColumn("last", F.col("source").isNull()), ["last", "source"]).withColumn("rank", F.col("rank") + 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    weighed = placed.select("source", "source_size", "rank", weight.alias("weight"), (most_epochs * F.col("source_size")).alias("full"))
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0.0))).first()[0]
    level = 0.0
    while True:
        left = F.lit(level) * F.col("weight") < F.col("full")
        filled, open_ = weighed.agg(F.coalesce(F.sum(F.when(~left, F.col("full"))), F.lit(0.0)), F.sum(F.when(left, F.col("weight")))).first()
        higher = (total - filled) / open_ if open_ else level
        if higher <= level:
            break
        level = higher
    filling = F.lit(level) * F.col("weight")
    target = F.when(filling >= F.col("full"), F.col("full")).otherwise(filling).cast("double")
    return weighed.select("source", "source_size", "rank", ((F.col("rank") - 1) % len(SCHEDULES)).alias("schedule"), "weight", target.alias("target"))


def _placed(docs: DataFrame, weights: tuple[float, ...], most_epochs: int, rows: bool) -> DataFrame:
    """One row per document: doc_id, source, size, the words of its source that stand before it (start), source_size, target,
    schedule; with ``rows``, the document's own columns as the struct row."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if rows else []),
    )
    # a hash that any SQL has, so that the order can be had elsewhere too
    spin = F.conv(F.substring(F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size")), 1, 15), 16, 10).cast("long")
    bucket = F.pmod("spin", F.lit(BUCKETS))
    # one key for the join and the window, so that documents are shuffled by it once; a null source has no like
    key = F.concat_ws(":", bucket.cast("string"), F.col("source"))
    slim = cut(sized.withColumn("spin", spin).withColumn("bucket", bucket).withColumn("key", F.when(F.col("source").isNull(), F.concat(F.lit("-"), key)).otherwise(key)))
    buckets = cut(slim.groupBy("source", "bucket", "key").agg(F.sum("size").alias("bucket_size")))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").cast("double").alias("source_size")), weights, most_epochs)
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0)))
    facts = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("key", "bucket_start", F.col("source_size").cast("long").alias("source_size"), "target", "schedule")
    in_bucket = Window.partitionBy("key").orderBy("spin", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return slim.join(facts, "key").withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))


def _wanted(lap: int) -> Column:
    """Words of the document that the mix takes in this lap over its source."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - F.col("start") - lap * F.col("source_size")))


def _position(lap: int) -> Column:
    begin = F.col("start") + lap * F.col("source_size")
    return position(F.when(F.col("target") > 0, begin / F.col("target")).otherwise(F.lit(1.0)), F.col("schedule"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and position, that of its first use; ``positions``
    has those of all its uses, in order."""
    placed = _placed(docs, weights, most_epochs, False)
    wanted = [_wanted(lap) for lap in range(most_epochs)]
    every = F.array_compact(F.array(*(F.when(wanted[lap] > 0, _position(lap)) for lap in range(most_epochs))))
    return placed.select("doc_id", "source", "size", "source_size", "target", sum(wanted[1:], wanted[0]).cast("long").alias("taken"), _position(0).alias("position"), every.alias("positions"))


def uses(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The rows of docs, with their columns alone, as often as the mix uses them, range-sorted by the position of each use. A
    document is used whole: where the mix takes a part of it, if that is half of its words or more."""
    placed = _placed(docs, weights, most_epochs, True)
    laps = F.array_compact(F.array(*(F.when((_wanted(lap) > 0) & (2 * _wanted(lap) >= F.col("size")), _position(lap)) for lap in range(most_epochs))))
    return in_order(placed.select("doc_id", "row", F.explode(laps).alias("position"))).select("row.*")


def in_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by training position; ties by id."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, "position", "doc_id").sortWithinPartitions("position", "doc_id")
