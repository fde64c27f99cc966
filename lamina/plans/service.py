"""What the endpoints of a service would call: camelCase dicts in, (status, camelCase dict) out."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import KOREAN_POLICY, Rules
from ..functions.text import camel
from ..operators.chunks import chunk_pipeline
from ..operators.ingest import REQUEST_FIELDS, analyse
from ..operators.layout import page_texts
from ..operators.retrieval import answers, first_sentences, hit_rows
from ..operators.vectors import cosine_top_k, embedded
from ..sources.files import ChunkStore, decoded, download_name, http_get, http_parts, http_sender, post_payloads, read_pdfs, saved_downloads, write_json
from .settings import Settings

RAG_FIELDS = ("user_id", "trip_id", "policy_id", "question")
FAILED = {"error": "internal error"}


def open_store(spark: SparkSession, settings: Settings) -> ChunkStore:
    return ChunkStore(spark, settings.store_path)


def rules_for(settings: Settings, rules: Rules = KOREAN_POLICY) -> Rules:
    return rules.with_keywords(settings.keyword_path) if settings.keyword_path else rules


def checked(request: dict, fields: tuple[str, ...]) -> list[str]:
    """Names of required fields that are missing or not strings."""
    return [camel(f) for f in fields if not isinstance(request.get(camel(f)), str)]


class Service:
    """pages_of gives the pages of a downloaded document; an answer is only ever drawn from stored chunks."""

    def __init__(self, spark: SparkSession, store: ChunkStore, rules: Rules, embed: Callable, pages_of: Callable[[dict], DataFrame], send: Callable | None = None, answerer=first_sentences, top_k: int = 8, embed_batch: int = 50):
        self.spark, self.store, self.rules, self.embed = spark, store, rules, embed
        self.pages_of, self.send, self.answerer, self.top_k, self.embed_batch = pages_of, send, answerer, top_k, embed_batch

    def health(self) -> tuple[int, dict]:
        return 200, {"status": "ok"}

    def start_analysis(self, request: dict) -> tuple[int, dict]:
        """Accepts a request; run_analysis does the work."""
        if missing := checked(request, REQUEST_FIELDS):
            return 422, {"missing": missing}
        return 202, {"analysisResultId": request["analysisResultId"], "status": "ACCEPTED"}

    def run_analysis(self, request: dict) -> dict:
        """Saves the document's chunks, then sends the callback; any error becomes a failure callback, whose own failure is swallowed."""
        try:
            row = self.spark.createDataFrame([[request[camel(f)] for f in REQUEST_FIELDS]], ", ".join(f"{f} string" for f in REQUEST_FIELDS))
            status = analyse(row, self.pages_of(request), self.rules, self.embed, self.store, self.embed_batch).select("path", "body").first()
            path, body = status["path"], status["body"]
        except Exception as e:
            path, body = "fail", json.dumps({"analysisResultId": request.get("analysisResultId"), "status": "FAILED", "errorMessage": str(e)}, ensure_ascii=False)
        post_payloads(self.spark.createDataFrame([(path, body)], "path string, body string"), self.send).collect()
        return json.loads(body)

    def query_policy(self, request: dict) -> tuple[int, dict]:
        if missing := checked(request, RAG_FIELDS):
            return 422, {"missing": missing}
        try:
            asked = self.spark.createDataFrame([(1, request["question"], request["policyId"])], "query_id long, question string, policy_id string")
            vectors = embedded(asked, "query_id", "question", self.embed).withColumnRenamed("vector", "query_vector").join(asked, "query_id")
            stored = self.store.of_policies(asked)  # a policy's own files, for search, hits and related chunks alike
            chunks = hit_rows(stored.drop("vector"))
            corpus = stored.select(F.col("chunk_id").alias("id"), "vector", "policy_id")
            found = cosine_top_k(vectors.select("query_id", "query_vector", "policy_id"), corpus, self.top_k, "policy_id")
            hits = found.join(chunks, F.col("id") == F.col("chunk_id")).drop("id")
            answer = answers(asked.select("query_id", "question"), hits, chunks, self.answerer).first()
            return 200, {"answer": answer["answer"], "sources": [s.asDict() for s in answer["sources"]]}
        except Exception:
            return 500, FAILED


def whole(blocks: DataFrame) -> DataFrame:
    """blocks, if every document could be decoded; else ValueError."""
    if bad := blocks.where("error is not null").select("doc_id", "error").first():
        raise ValueError(f"{bad['doc_id']}: {bad['error']}")
    return blocks


def glob_escaped(path: str) -> str:
    return re.sub(r"([\\\[\]{}*?,])", r"\\\1", path)


def downloaded_pages(spark: SparkSession, settings: Settings, decode: Callable[[bytes], list[dict]]) -> Callable[[dict], DataFrame]:
    """pages_of a request: its document, decoded under the request's document id.

    With a download folder, an executor streams it there as <document_id>.pdf; else its bytes pass the driver.
    """

    def pages_of(request: dict) -> DataFrame:
        doc, url = request["documentId"], request["downloadUrl"]
        if settings.download_path:
            asked = spark.createDataFrame([(doc, url)], "document_id string, download_url string")
            seconds = settings.download_seconds
            done = saved_downloads(asked, settings.download_path, lambda u: http_parts(u, seconds)).first()
            if done["error"]:
                raise ValueError(f"{doc}: {done['error']}")
            found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(glob_escaped(f"{settings.download_path}/{download_name(doc)}"))
            file = found.select(F.lit(doc).alias("doc_id"), "content")
        else:
            content = http_get(url, settings.download_seconds)
            file = spark.createDataFrame([(doc, bytearray(content))], "doc_id string, content binary")
        return page_texts(whole(decoded(file, decode)))

    return pages_of


def service_of(spark: SparkSession, settings: Settings, embed: Callable, decode: Callable[[bytes], list[dict]], rules: Rules = KOREAN_POLICY, answerer=first_sentences) -> Service:
    """The service that settings describe: its store, keywords, downloads, callbacks and sizes."""
    pages_of = downloaded_pages(spark, settings, decode)
    send = http_sender(settings.callback_url, settings.callback_seconds)
    return Service(spark, open_store(spark, settings), rules_for(settings, rules), embed, pages_of, send, answerer, settings.top_k, settings.embed_batch)


def run_documents(spark: SparkSession, pdfs: str, decode: Callable[[bytes], list[dict]], rules: Rules, out: str) -> DataFrame:
    """All documents of a glob to pages and chunks, written as JSON under out; the chunks. A document that can't be decoded ends the run."""
    blocks = whole(read_pdfs(spark, pdfs, decode))
    pages = page_texts(blocks)
    write_json(pages, f"{out}/pages")
    chunks = chunk_pipeline(pages, rules)
    write_json(chunks, f"{out}/chunks")
    return chunks
