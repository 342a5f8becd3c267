"""Queries of the operators with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import brown_lm, jaccard_join, language_id, maxscore, mixing, passages, piece_codec, quality_classifier, quality_rules, sharding
from weft.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.in_order(mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents"), give=piece_codec.DIGEST)


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.lm_score(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_quality_classifier, op3_hilbert_sharding, op4_jaccard_join, op5_passages, op6_maxscore, op7_sentencepiece, op8_brown_lm, op9_language_id, op10_quality_rules)}


#: Words of a text, A-Z lower-cased.
WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({WORDS}, []) AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM both_ JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 75 * (a.n + b.n - k)), hop AS (SELECT u, v FROM link UNION SELECT hop.u, link.v FROM hop JOIN link ON hop.v = link.u),
low AS (SELECT u AS doc_id, min(v) AS low FROM hop GROUP BY 1) SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20"""


def _position_sql(fraction: str) -> str:
    """``mixing.position`` of a fraction by schedule."""
    cases = []
    for k, knots in enumerate(mixing.SCHEDULES):
        parts = mixing.segments(knots)
        ends = [a for *_, a in parts[1:]] + [None]
        whens = []
        for (t, m, s, a), end in zip(parts, ends, strict=True):
            at = f"{t!r}::DOUBLE + 2 * ({fraction} - {a!r}::DOUBLE) / ({m!r}::DOUBLE + sqrt(greatest(0.0, {m * m!r}::DOUBLE + {2 * s!r}::DOUBLE * ({fraction} - {a!r}::DOUBLE))))"
            whens.append(f"WHEN {fraction} < {end!r}::DOUBLE THEN {at}" if end is not None else f"ELSE {at}")
        cases.append(f"WHEN {k} THEN CASE WHEN {fraction} >= 1 THEN {fraction} {' '.join(whens)} END")
    return f"CASE schedule {' '.join(cases)} END"


MIX = rf"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents), spun AS (SELECT *, ('0x' || substr(md5(concat_ws(' ', coalesce(doc_id::VARCHAR, ''), size::VARCHAR)), 1, 15))::BIGINT AS spin FROM d),
src AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY 1), ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM src), weighed AS (SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, 3 * source_size AS full_ FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(full_) OVER (ORDER BY full_ / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY full_ / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
filled AS (SELECT *, level * weight >= full_ AS is_full FROM levels), t AS (SELECT source, source_size::BIGINT AS source_size, (rank - 1) % 3 AS schedule, CASE WHEN is_full THEN full_ ELSE max(level) FILTER (NOT is_full) OVER () * weight END AS target FROM filled),
placed AS (SELECT doc_id, size, source_size, schedule, target, coalesce(sum(size) OVER (PARTITION BY spun.source ORDER BY spin % 4096, spin, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ FROM spun JOIN t ON spun.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN target > 0 THEN start_ / target ELSE 1.0 END::DOUBLE AS fraction FROM placed)
SELECT doc_id, size, source_size, target, ({' + '.join(f'greatest(0, least(size, round(target)::BIGINT - start_ - {lap} * source_size))' for lap in range(mixing.MOST_EPOCHS))})::BIGINT AS taken, round({_position_sql('fraction')}, 6) AS position FROM f"""


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express; the others are tested against plain versions."""
    return {"op1_mixing": MIX, "op4_jaccard_join": JACCARD, "op6_maxscore": TOP_K}
