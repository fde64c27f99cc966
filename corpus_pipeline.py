"""The corpus pipeline over `documents`.

Documents that the quality classifier rejects go; of each group of near
duplicates the one with the smallest doc_id stays; secrets are replaced by a
mark; sources are mixed to their target weights, so a document is repeated, or
cut, or left out, as its source needs, in training order; and what remains is
encoded, decoded and compared. Each stage is written as Parquet before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import quality, secret_scan, sentence_pieces, simhash_dedup, source_mix
from lamina.llm.common import ready, released, saved, table, written
from lamina.llm.queries import PIECES


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return quality.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return simhash_dedup.one_of_similar(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of each row, n_ids, and the SHA-256 of the text decoded from them."""
    ready(spark)
    return sentence_pieces.encoded_and_checked(docs, PIECES)


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The classifier, hashes and encoder are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote for itself, and read, goes when its rows are written."""
    docs, since = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
        released(since)
    return docs
