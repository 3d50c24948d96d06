"""The registered queries of this subpackage; each derives its contract's columns from an operator's outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from revlake.llm import common, exact_topk, jaccard_join, line_dedup, mixing, neighbours, packing, quality, suffix_dedup, token_counts, toxicity


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(common.table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(common.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(common.table(spark, sf_dir, "documents")).drop("spans")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return exact_topk.exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.crc32_of_id("doc_id") % 4 == 2
    known = toxicity.known_labels(common.table(spark, sf_dir, "labels").where(~held_out), "quality")
    return quality.quality(docs, known).select("doc_id", held_out.alias("held_out"), "score", "predicted", "good", "n_lines")


#: Target weights of op8_mixing and of the pipeline; other sources have weight 1.
WEIGHTS = {"src0": 4, "src1": 3, "src2": 3, "src3": 2, "src4": 2}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), common.scratch(spark, "token-cache"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.crc32_of_id("doc_id") % 3 == 1
    learn = toxicity.label_rows(docs, common.table(spark, sf_dir, "labels"), "toxic").where(~held_out)
    return toxicity.toxicity(docs, learn).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_line_dedup, op3_packing, op4_neighbours, op5_suffix_dedup, op6_exact_topk, op7_quality, op8_mixing, op9_token_counts, op10_toxicity)}
ORACLE: dict[str, str] = {
    "op8_mixing": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce('=' || source, '') AS s, CASE source {' '.join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS.items())} ELSE 1 END AS w FROM documents),
        src AS (SELECT s, w, row_number() OVER (ORDER BY w DESC, s) AS i FROM (SELECT DISTINCT s, w FROM d)),
        tot AS (SELECT CAST(sum(w) AS BIGINT) AS total, count(*) AS n FROM src),
        run AS (
            SELECT CAST(-1 AS BIGINT) AS t, list_transform(range(n), lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS j FROM tot
            UNION ALL
            SELECT t + 1, list_transform(done, lambda x, k: x + CASE WHEN k = p THEN 1 ELSE 0 END), p, done[p]
            FROM (SELECT t, any_value(done) AS done, arg_min(i, (((done[i] + 1) * total + w - 1) // w) * 1000000 + i) AS p FROM run, src, tot
                  WHERE t + 1 < total AND done[i] < w AND done[i] * total // w <= t + 1 GROUP BY t)),
        ranked AS (SELECT doc_id, source, i, w, row_number() OVER (PARTITION BY i ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1 AS r FROM d JOIN src USING (s, w)),
        timed AS (SELECT doc_id, source, r // 64 AS block, CAST(r // 64 // w * total + t AS BIGINT) AS slot, r FROM ranked, tot, run WHERE pick = i AND t >= 0 AND j = r // 64 % w)
        SELECT doc_id, source, block, slot, row_number() OVER (ORDER BY slot, r) - 1 AS position FROM timed""",
    "op6_exact_topk": """
        WITH valid AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM valid q JOIN valid c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w))
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5""",
}
