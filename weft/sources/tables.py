"""Loaders, and the text front end that turns documents into fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_fragments(docs: DataFrame, least_words: int = 4) -> DataFrame:
    """A fragment for each line of enough words: doc_id, source, lang, seq, start_at, end_at (half-open), n_words, words and line. Starts
    are summed within the row, before lines become rows, so nothing is shuffled."""
    lines = F.split("text", "\n")
    ends = F.aggregate(lines, F.array(F.lit(0).cast("long")), lambda acc, l: F.array_append(acc, F.element_at(acc, -1) + F.length(l) + 1))
    each = docs.select("doc_id", "source", "lang", F.posexplode(F.arrays_zip(lines.alias("line"), F.slice(ends, 1, F.size(lines)).alias("start_at"))).alias("at", "x"))
    return (
        each.select("*", "x.*").withColumn("words", X.words(F.col("line")))
        .where(F.size("words") >= least_words)
        .select("doc_id", "source", "lang", (F.col("at") + 1).alias("seq"), "start_at", (F.col("start_at") + F.length("line")).alias("end_at"), F.size("words").alias("n_words"), "words", "line")
    )


def shaped(fragments: DataFrame) -> DataFrame:
    """Adds l0, l1 (hashes of both levels) and literal_share; keeps no tokens."""
    return fragments.select(
        "doc_id", "source", "lang", "seq", "start_at", "end_at", "n_words",
        X.stream_hash(F.col("words")).alias("l0"), X.stream_hash(X.alpha_rename(F.col("words"))).alias("l1"), X.literal_share(F.col("words")).alias("literal_share"),
    )
