"""The operators as queries over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, clustering, decontaminate, language_id, license_scan, media, neardup, quality, quote_linking, rank_bpe, secret_scan, token_output, whitening
from corvane.session import table


def tokenizer_path(name: str) -> str:
    """A public tokenizer file's place on the machine; workers read their own copy of it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    """The pattern that goes with the public rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licences(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secrets(table(spark, sf_dir, "documents")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op5_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_linking.threads(table(spark, sf_dir, "conversations"))


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.telephony(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.contamination(docs.select("doc_id", "text"), bench))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_shards(token_output.write_shards(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op11_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.encode_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern())


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings")).drop("scans")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return made.withColumn("deviation", F.col("deviation").cast("bigint"))


_ALL = (
    op1_language_id,
    op2_license_scan,
    op3_secret_scan,
    op4_quality_classifier,
    op5_quote_linking,
    op6_bpe_roundtrip,
    op7_media_columns,
    op8_decontaminate,
    op9_minhash_dedup,
    op10_token_output,
    op11_rank_bpe,
    op12_centroid_clustering,
    op13_embedding_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan.oracle(), "op8_decontaminate": decontaminate.oracle(), "op9_minhash_dedup": neardup.oracle(), "op12_centroid_clustering": clustering.oracle()}
