"""The training-data pipeline over documents: each stage's rows are written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import jaccard_join, mixing, passages, piece_codec, quality_classifier
from weft.llm.common import cut, release, table, tables_of


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps. Learned from ``labels`` and this stage's documents; a null or empty text has
    the score of no words; rows are judged one by one, so repeated rows stay or go together; without
    labels nothing is rejected. Other columns pass through."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, of its smallest id; null ids come last. Rows without words are in no component
    and all stay; repeated rows, and rows that share an id within a component, are one. Other columns pass through."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that they have from another document, which keeps them; n_chars counts again. A
    document that is left without a word goes; null and empty texts stay. Rows that share an id are documents of their own, and rows
    with a null id are searched too. Other columns pass through."""
    return passages.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix uses it (not at all, where its source has more than its target; nor without a word), in
    training order: the rows are range-sorted by the position of each use, part files and rows within them standing in that
    order. The columns are those of docs, whatever they are."""
    return mixing.uses(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of every row, and its place in training order: the number of the file that it was read from (part) and of its
    row there (row); both null if docs come from no file. A null text has null ids, an empty one none."""
    placed = in_file_order(docs)
    return piece_codec.encode(placed, keep=("part", "row"))


def in_file_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, part and row of docs that are read from files as Spark writes them."""
    rows = docs.select("doc_id", "text")
    try:
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
        return docs.select("doc_id", "text", name.alias("part"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # not a file
        return rows.withColumns({"part": F.lit(None).cast("long"), "row": F.lit(None).cast("long")})


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("encoding", encoding)]

#: Several stages learn or search in ways that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written for itself is deleted when its result is, and that when the next one's is."""
    docs, read = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with tables_of(spark) as keep:
            made = cut(stage(spark, docs, sf_dir))
            keep.add(made.weft_path)
        if read is not None:
            release(read)
        docs = read = made
    return STAGES[-1][1](spark, docs, sf_dir)
