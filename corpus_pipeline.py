"""The corpus pipeline: five stages over documents, each calling one operator of corvane.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes what a stage returns as
Parquet in the shared folder and reads it again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontaminate, neardup, quality, secret_scan
from corvane.llm.common import compact, dropped, written
from corvane.llm.queries import tokenizer_path
from corvane.session import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a probability of 0.3 or more of being good."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return compact(quality.scored(docs, model, name="quality_score").where(F.col("quality_score") >= 0.3).select(*docs.columns))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id."""
    return compact(neardup.deduplicated(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; those with one go whole."""
    return compact(decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark")))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark that tells an owner's live one from a copied example."""
    found = written(secret_scan.secrets(docs), "found")
    out = secret_scan.masked(docs, found)
    return compact(out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else out)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return compact(bpe.encode_digest(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("bpe", encode_stage),
]

#: SQL can't express the classifier nor the tokenizer; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for the table documents. A stage's table goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
