"""JSON and Parquet tables, PDF decoding and downloads behind plain functions."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import file_stem
from .store import ChunkStore as ChunkStore

PAGES = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])
CHUNKS = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("chunk_id", "source_file")],
        *[T.StructField(c, T.LongType()) for c in ("page_start", "page_end")],
        *[T.StructField(c, T.StringType()) for c in ("section_title", "coverage_type", "text")],
        T.StructField("char_count", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("matched_category", "secondary_category", "matched_keyword", "related_chunk_id")],
        *[T.StructField(c, T.StringType()) for c in ("user_id", "trip_id", "policy_id", "document_id")],
    ]
)
BLOCKS = "doc_id string, page int, block_idx int, x0 double, y0 double, x1 double, y1 double, text string, block_type int, page_w double, page_h double, error string"


class EmptyFile(ValueError):
    """A JSON file without content."""


def _files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files a glob matches, in order; FileNotFoundError if none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    files = sorted((f.getPath().toString(), f.getLen()) for f in found)
    if not files:
        raise FileNotFoundError(pattern)
    return files


def read_json(spark: SparkSession, pattern: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Rows of JSON arrays with doc_id, the file's stem.

    Strict: missing, empty and malformed files raise FileNotFoundError,
    EmptyFile and Spark's own error; else only missing ones do.
    """
    files = _files(spark, pattern)
    if strict and (empty := [f for f, size in files if not size]):
        raise EmptyFile(empty[0])
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.json([f for f, _ in files]).withColumn("doc_id", file_stem(F.input_file_name()))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_vectors(spark: SparkSession, pattern: str) -> DataFrame:
    """(doc_id, chunk_id, vector) from JSON objects of chunk_id to numbers."""
    files = _files(spark, pattern)
    whole = spark.read.text([f for f, _ in files], wholetext=True).withColumn("doc_id", file_stem(F.input_file_name()))
    return whole.select("doc_id", F.explode(F.from_json("value", "map<string,array<float>>")).alias("chunk_id", "vector"))


def joined(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors, ["doc_id", "chunk_id"])


def with_scope(chunks: DataFrame, user_id: str, trip_id: str, policy_id: str, document_id: str) -> DataFrame:
    given = {"user_id": user_id, "trip_id": trip_id, "policy_id": policy_id, "document_id": document_id}
    return chunks.withColumns({k: F.lit(v) for k, v in given.items()})


def with_local_scope(chunks: DataFrame) -> DataFrame:
    """Where policy_id is missing, names by the document's, each only if itself missing."""
    stem = F.col("doc_id").cast("string")
    missing = F.coalesce(F.col("policy_id"), F.lit("")) == ""
    fill = lambda c, value: F.when(missing & (F.coalesce(F.col(c), F.lit("")) == ""), value).otherwise(F.col(c))
    return chunks.withColumns(
        {
            "user_id": fill("user_id", F.concat(F.lit("local-user-"), stem)),
            "trip_id": fill("trip_id", F.concat(F.lit("local-trip-"), stem)),
            "document_id": fill("document_id", stem),
            "policy_id": fill("policy_id", stem),
        }
    )


def decoded(files: DataFrame, decode: Callable[[bytes], list[dict]]) -> DataFrame:
    """blocks of files (doc_id, content); decode gives a block for each dict, pages from 1. A file that can't be decoded gives one row with its error."""
    import json

    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    rows = [{"doc_id": doc, "error": None, **b} for b in decode(bytes(content))]
                except Exception as e:
                    rows = [{"doc_id": doc, "error": json.dumps(str(e))}]
                yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})

    return files.select("doc_id", "content").mapInPandas(run, BLOCKS)


def read_pdfs(spark: SparkSession, pattern: str, decode: Callable[[bytes], list[dict]]) -> DataFrame:
    """decoded() of the files that a glob matches, by their stems."""
    _files(spark, pattern)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return decoded(spark.read.format("binaryFile").load(pattern).select(stem.alias("doc_id"), "content"), decode)


def fetched(requests: DataFrame, fetch: Callable[[str], bytes]) -> DataFrame:
    """(document_id, content, error) of each request's download_url."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, url in zip(pdf["document_id"], pdf["download_url"], strict=True):
                try:
                    rows.append((doc, fetch(url), None))
                except Exception as e:
                    rows.append((doc, None, str(e)))
            yield pd.DataFrame(rows, columns=["document_id", "content", "error"])

    return requests.select("document_id", "download_url").mapInPandas(run, "document_id string, content binary, error string")


def http_parts(url: str, timeout: float = 30.0, size: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes, a part at a time."""
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as answer:
        while part := answer.read(size):
            yield part


def download_name(document_id: str) -> str:
    """<document_id>.pdf; characters that a file name can't have are escaped."""
    from urllib.parse import quote

    return f"{quote(document_id, safe=' ')}.pdf"


def saved_downloads(requests: DataFrame, folder: str, parts: Callable[[str], Iterator[bytes]] = http_parts) -> DataFrame:
    """(document_id, path, n_bytes, error) of each request's download_url, streamed by executors to <document_id>.pdf in a folder that all of them have mounted.

    A file appears when it is whole, and replaces an earlier one. Failures are rows with an error.
    """
    import os
    import uuid

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, url in zip(pdf["document_id"], pdf["download_url"], strict=True):
                draft = os.path.join(folder, f".{uuid.uuid4().hex}")
                try:
                    path, n = os.path.join(folder, download_name(doc)), 0
                    os.makedirs(folder, exist_ok=True)
                    with open(draft, "wb") as file:
                        for part in parts(url):
                            n += file.write(part)
                    os.replace(draft, path)
                    rows.append((doc, path, n, None))
                except Exception as e:
                    if os.path.exists(draft):
                        os.remove(draft)
                    rows.append((doc, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["document_id", "path", "n_bytes", "error"]).astype({"n_bytes": "Int64"})

    return requests.select("document_id", "download_url").mapInPandas(run, "document_id string, path string, n_bytes long, error string")


def http_get(url: str, timeout: float = 30.0) -> bytes:
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as answer:
        return answer.read()


class CallbackError(RuntimeError):
    """A callback that the receiver did not take."""


def http_sender(base: str, timeout: float = 10.0) -> Callable[[str, str], None] | None:
    """Posts JSON bodies to paths below base; None, with a warning, where base is empty."""
    if not base:
        logging.getLogger(__name__).warning("no callback URL is set: callbacks are not sent")
        return None

    def send(path: str, body: str) -> None:
        from urllib.error import URLError
        from urllib.request import Request, urlopen

        url = f"{base.rstrip('/')}/{path.lstrip('/')}"
        try:
            with urlopen(Request(url, body.encode(), {"Content-Type": "application/json"}, method="POST"), timeout=timeout):
                return
        except (URLError, OSError) as e:
            raise CallbackError(f"{url}: {e}") from e

    return send


def post_payloads(payloads: DataFrame, send: Callable[[str, str], None] | None) -> DataFrame:
    """(path, sent, error) of each payload (path, body); without a sender none is sent. An error in sending is reported, not raised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, body in zip(pdf["path"], pdf["body"], strict=True):
                try:
                    if send:
                        send(path, body)
                    rows.append((path, bool(send), None))
                except Exception as e:
                    rows.append((path, False, str(e)))
            yield pd.DataFrame(rows, columns=["path", "sent", "error"])

    return payloads.select("path", "body").mapInPandas(run, "path string, sent boolean, error string")
