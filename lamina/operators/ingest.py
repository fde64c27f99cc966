"""Analysis jobs: requests to chunks, vectors, status and callback payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rules
from ..functions.text import camel, embed_text
from ..sources.files import ChunkStore, with_local_scope
from .chunks import chunk_pipeline
from .vectors import embedded

REQUEST_FIELDS = ("analysis_result_id", "document_id", "download_url", "user_id", "trip_id", "policy_id")


def valid(rows: DataFrame, fields: tuple[str, ...]) -> Column:
    """Whether all required fields are given."""
    ok = F.lit(True)
    for f in fields:
        ok = ok & F.col(f).isNotNull()
    return ok


def camel_case(df: DataFrame) -> DataFrame:
    return df.toDF(*[camel(c) for c in df.columns])


def coverage_items(chunks: DataFrame) -> DataFrame:
    """title, coverage_status, limit_amount (not known), source_chunk_ids of chunks with a category."""
    return chunks.where("matched_category <> ''").select(
        "doc_id", F.col("section_title").alias("title"), F.col("coverage_type").alias("coverage_status"),
        F.lit(None).cast("long").alias("limit_amount"), F.array("chunk_id").alias("source_chunk_ids"),
    )


def chunk_texts(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_id", embed_text(F.col("section_title"), F.col("text")).alias("embed_text"))


def analyse(requests: DataFrame, pages: DataFrame, rules: Rules, embed, store: ChunkStore, batch: int = 50) -> DataFrame:
    """Chunks, embeds and saves the requests' documents; then status rows (analysis_result_id, path, body).

    Requests whose document gives no chunks now, or that miss a field, fail alone,
    whatever the store holds of earlier runs. Of several requests for one document
    the one with the greatest analysis_result_id gives user, trip and policy. Chunks
    are made once, saved with their vectors before any payload is made, and read back.
    """
    ok = valid(requests, REQUEST_FIELDS)
    scope = (
        requests.where(ok).groupBy(F.col("document_id").alias("doc_id"))
        .agg(F.max(F.struct("analysis_result_id", "user_id", "trip_id", "policy_id")).alias("r"))
        .select("doc_id", "r.user_id", "r.trip_id", "r.policy_id")
    )
    chunks = chunk_pipeline(pages.join(scope.select("doc_id"), "doc_id", "left_semi"), rules)
    chunks = store.staged(with_local_scope(chunks.join(scope, "doc_id").withColumn("document_id", F.col("doc_id"))))
    vectors = embedded(chunk_texts(chunks), "chunk_id", "embed_text", embed, batch, keep=("doc_id",))
    save_id = store.save(chunks, vectors)
    if store.version():
        chunks = store.rows(save_id)
    items = (
        coverage_items(chunks)
        .groupBy("doc_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("source_chunk_ids").alias("sourceChunkIds"), "title", F.col("coverage_status").alias("coverageStatus"), F.col("limit_amount").alias("limitAmount")
                    )
                )
            ).alias("items")
        )
    )
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    done = requests.withColumn("doc_id", F.col("document_id")).join(counts, "doc_id", "left").join(items, "doc_id", "left")
    complete = F.to_json(
        F.struct(
            F.col("analysis_result_id").alias("analysisResultId"), F.lit("COMPLETED").alias("status"),
            F.concat(F.col("n").cast("string"), F.lit(" chunks")).alias("summary"), F.col("items").alias("coverageItems"),
        )
    )
    reason = F.when(~ok, F.lit("a required field is missing")).otherwise(F.lit("the document has no pages"))
    failed = F.to_json(F.struct(F.col("analysis_result_id").alias("analysisResultId"), F.lit("FAILED").alias("status"), reason.alias("errorMessage")))
    good = ok & F.col("n").isNotNull()
    return done.select(
        "analysis_result_id", F.when(good, F.lit("complete")).otherwise(F.lit("fail")).alias("path"), F.when(good, complete).otherwise(failed).alias("body")
    )
