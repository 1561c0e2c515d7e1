"""The corpus pipeline: quality rules, near copies, secrets, mixing, tokens. Each stage's rows are written and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldglass.llm import bpe, mixing, quality, secrets, shingles
from fieldglass.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the trees reject go: null and empty texts among them. Repeated rows are judged each; an empty table stays empty; other columns are passed on."""
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays: SimHash fingerprints find them, and MinHash those that are further apart; similarity of five-word shingles (0.8 or more) decides.

    Null and empty texts are copies of each other; rows of one id with unlike texts all stay, equal ones once; rows
    without id stay; an empty table stays empty; other columns are passed on, whatever their names and types.
    """
    return shingles.dedup(docs, words=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, null, empty and repeated ones too; an empty table stays empty."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's target asks. Texts without words add nothing and go; null sources are one source; repeated rows each count; an empty table stays empty."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the ids (little-endian unsigned 32-bit) of each row, repeated ones each; null and empty texts have none; an empty table gives an empty result."""
    rows = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc.doc_id", "doc.source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("quality_rules", quality_rules), ("near_copies", near_copies), ("secret_scan", secret_scan), ("mix_sources", source_mix), ("bpe", tokens)]

#: Boosted trees, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written as Parquet to the cluster's shared folder for the next."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
