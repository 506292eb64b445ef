"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, mixing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op2_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op5_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


def op7_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.bpe import round_trip

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, carry=["doc_id"])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.katz import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_documents": op1_shard_documents,
    "op2_find_pii": op2_find_pii,
    "op3_simhash_components": op3_simhash_components,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_score_quality": op5_score_quality,
    "op6_mix_sources": op6_mix_sources,
    "op7_score_toxicity": op7_score_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_katz_scores": op10_katz_scores,
}

ORACLES: dict[str, str] = {
    "op6_mix_sources": mixing.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
}
