"""Sharding along a Hilbert curve, with DataFrame operations only.

Metadata dimensions (language, source, length) are quantised to ``bits`` bits each: text values by their rank among the
distinct ones, lengths by their logarithm. The cell's index on the Hilbert curve orders the documents; runs of equal counts
of rows become the shards, so that each shard covers a compact box of the dimensions and files prune on any of them.

Rows are range-partitioned by (curve index, hash, id), so a cell with any share of all rows is cut within; a row's rank is
its number within its partition plus the rows of the partitions before.

Defined results: law ``rows``: counts of any two shards differ by one at most; null dimensions are the last cell of theirs;
a null text has size 8 and a null crc32; repeated rows get slots of their own; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import cut, shuffle_partitions

BITS = 5


def _rotate(x: Column, by: Column, n: int) -> Column:
    """Rotate n bits to the left."""
    by = by % n
    mask = (1 << n) - 1
    return (F.call_function("shiftleft", x, by).bitwiseOR(F.call_function("shiftright", x, F.lit(n) - by))).bitwiseAND(F.lit(mask))


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Curve index of integer coordinates below 2**bits: at each level the cell's corner, seen from the current entry
    point and direction, is put in Gray-code order; the corner then sets the next entry point and direction."""
    n = len(dims)
    size = 1 << n
    gray = [w ^ (w >> 1) for w in range(size)]
    order = [gray.index(c) for c in range(size)]
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(size)]

    def trailing_ones(w: int) -> int:
        return (w ^ (w + 1)).bit_length() - 1

    turn = [0 if w == 0 else trailing_ones(w - 1 if w % 2 == 0 else w) % n for w in range(size)]
    tables = {name: F.array(*map(F.lit, v)) for name, v in (("order", order), ("entry", entry), ("turn", turn))}

    def level(state: Column, i: Column) -> Column:
        bit = [F.call_function("shiftright", d, i).bitwiseAND(F.lit(1)) for d in dims]
        corner = reduce(lambda a, b: a.bitwiseOR(b), (F.call_function("shiftleft", b, F.lit(k)) for k, b in enumerate(bit)))
        step = state["turn"] + 1
        seen = _rotate(corner.bitwiseXOR(state["entry"]), F.lit(2 * n) - step, n)
        w = F.element_at(tables["order"], seen + 1)
        return F.struct(
            (state["index"] * size + w).alias("index"),
            state["entry"].bitwiseXOR(_rotate(F.element_at(tables["entry"], w + 1), step, n)).alias("entry"),
            ((state["turn"] + F.element_at(tables["turn"], w + 1) + 1) % n).alias("turn"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("entry"), F.lit(0).alias("turn"))
    return F.aggregate(F.array(*(F.lit(i) for i in reversed(range(bits)))), start, level)["index"]


def ranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``rank``, from 0, in the order of keys, and ``total``, the number of rows."""
    parts = max(2, shuffle_partitions(df.sparkSession))
    numbered = cut(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("row_number", F.monotonically_increasing_id()))
    part = F.shiftright("row_number", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sort: their number is a setting, not the data's
    counts = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("total", F.sum("rows").over(Window.partitionBy()))
    numbered = numbered.withColumn("part", part)
    return numbered.join(F.broadcast(counts), "part").withColumn("rank", F.col("start") + F.col("row_number").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "rows", "start", "row_number")


def cells(df: DataFrame, column: str, bits: int) -> DataFrame:
    """Cell of each distinct value of a text column: ranks in code-point order, scaled to 2**bits - 1 cells."""
    values = ranked(df.select(F.col(column).alias("value")).where("value is not null").distinct(), ["value"])
    return values.select("value", F.floor(F.col("rank") * ((1 << bits) - 1) / F.col("total")).cast("int").alias("cell"))


def hilbert_shards(docs: DataFrame, shards: int = 24, bits: int = BITS, text_dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    last = (1 << bits) - 1
    text = F.col("text").cast("string").cast("binary")
    slim = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        *(F.col(c).cast("string").alias(f"dim_{k}") for k, c in enumerate(text_dims)),
    ))
    for k in range(len(text_dims)):
        of = cells(slim, f"dim_{k}", bits).select(F.col("value").alias(f"dim_{k}"), F.col("cell").alias(f"cell_{k}"))
        slim = slim.join(of, f"dim_{k}", "left")
    length = F.least(F.lit(last), F.greatest(F.lit(0), F.floor(2 * F.log2(F.col("size") / 8.0)))).cast("int")
    dims = [F.coalesce(F.col(f"cell_{k}"), F.lit(last)) for k in range(len(text_dims))] + [length]
    keyed = slim.select("doc_id", "size", "text_crc32", hilbert_index(dims, bits).alias("curve"), F.xxhash64("doc_id", "text_crc32").alias("spin"))
    out = ranked(keyed, ["curve", "spin", "doc_id", "size"]).withColumn("shard", F.expr(f"(rank * {shards}) div total"))
    first = F.expr(f"(shard * total + {shards} - 1) div {shards}")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("curve").alias("curve_index"))
