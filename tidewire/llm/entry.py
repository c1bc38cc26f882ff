"""The queries of this package, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, htmltext, licenses, neardup, ngramlm, packing, resampling, runs, secretscan, sharding, tokenplanes, topk, toxicity
from tidewire.llm.common import scratch, small_batches, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secretscan.digest(secretscan.scan(table(spark, sf_dir, "documents")))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngramlm.score(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.classes(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = scratch(spark)
    tokenplanes.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokenplanes.read(spark, path).drop("ids")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return runs.digest(runs.find(table(spark, sf_dir, "documents"), rewrite=runs.repeated_tail))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return resampling.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_topk_search": op2_topk_search,
        "op3_hash_tree_sharding": op3_hash_tree_sharding,
        "op4_decontamination": op4_decontamination,
        "op5_secret_scan": op5_secret_scan,
        "op6_lm_score": op6_lm_score,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_html_main_text": op9_html_main_text,
        "op10_toxicity": op10_toxicity,
        "op11_token_planes": op11_token_planes,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_importance_resampling": op13_importance_resampling,
        "pipeline": pipeline,
    }


#: Exhaustive search in SQL: every query against every other row.
TOPK_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), queries AS (
    SELECT DISTINCT vec_id, w FROM whole WHERE vec_id % 100 = 0
), scored AS (
    SELECT q.vec_id AS query_id, q.w AS qw, c.vec_id,
           CAST(coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
    FROM queries q JOIN whole c ON c.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, qw ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS "rank", vec_id, score FROM ranked WHERE place <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_search": TOPK_SQL}
