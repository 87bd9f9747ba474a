"""Queries of this package's operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripleloom.llm import bpe, ivfpq, katz, langid, packing, quality_rules, sharding, simhash, weak_quality
from tripleloom.llm.common import tokenizer_path


#: Bytes of a shard in the query: small enough that the smallest tables split several times.
SHARD_BYTES = 64 << 10


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), SHARD_BYTES).withColumnRenamed("key", "doc_id")


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir))


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir))


def op4_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op7_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(documents(spark, sf_dir))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_extendible_sharding, op2_katz_backoff, op3_simhash_trie, op4_quality_llr, op5_ivf_pq,
        op6_token_counts, op7_hierarchical_packing, op8_language_id, op9_weak_label_quality, op10_bpe_round_trip,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_extendible_sharding": f"""
        WITH r AS (
          SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS place,
                 coalesce(strlen(text), 0) AS n_bytes
          FROM documents),
        levels AS (
          SELECT doc_id, n_bytes, d, place >> ({sharding.BITS} - d) AS prefix
          FROM r, (SELECT unnest(range(0, {sharding.BITS + 1}))::INT AS d)),
        buckets AS (SELECT d, prefix, sum(n_bytes) AS bucket_bytes, count(*) AS bucket_rows FROM levels GROUP BY d, prefix),
        first AS (
          SELECT l.doc_id, min(l.d) AS depth
          FROM levels l JOIN buckets b USING (d, prefix)
          WHERE b.bucket_bytes <= {SHARD_BYTES} OR b.bucket_rows = 1 GROUP BY l.doc_id)
        SELECT f.doc_id,
               CASE WHEN f.depth = 0 THEN '' ELSE right(lpad(bin(l.prefix), 64, '0'), f.depth) END AS shard,
               f.depth AS depth, CAST(0 AS BIGINT) AS page, CAST(l.n_bytes AS BIGINT) AS n_bytes,
               CAST(b.bucket_bytes AS BIGINT) AS bucket_bytes, b.bucket_rows AS bucket_rows
        FROM first f JOIN levels l ON l.doc_id = f.doc_id AND l.d = f.depth
        JOIN buckets b ON b.d = l.d AND b.prefix = l.prefix""",
}
