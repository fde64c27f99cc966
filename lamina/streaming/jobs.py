"""The chunk pipeline over arriving files of pages, and analysis jobs over arriving requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Rules
from ..operators.chunks import chunk_pipeline
from ..operators.ingest import REQUEST_FIELDS, analyse
from ..sources.store import ChunkStore, Files


def chunk_stream(spark: SparkSession, pages_dir: str, out_dir: str, checkpoint: str, rules: Rules):
    """Chunks each batch of arriving pages (doc_id string, page int, text string); a document comes whole in one file. Replaces documents that come again."""
    pages = spark.readStream.schema("doc_id string, page int, text string").parquet(pages_dir)

    def write(batch: DataFrame, _: int) -> None:
        chunks = chunk_pipeline(batch, rules)
        chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(out_dir)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Outbox:
    """Callbacks to send, and those that were taken, as tables under a path.

    waiting/batch=<n> holds what batch n made; writing a batch again replaces it. taken
    has a row for each callback that the receiver took, which is never sent again: it
    is named by its request and path, so a request that comes again in another batch
    with the same outcome is not told twice. Each task's rows are committed when it
    ends; a task that is lost after sending sends again, as receivers must expect.
    """

    KEY = ["analysis_result_id", "path"]

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)

    def put(self, batch: int, payloads: DataFrame) -> None:
        """payloads: analysis_result_id, path, body."""
        payloads.select(*self.KEY, "body").write.mode("overwrite").parquet(f"{self.path}/waiting/batch={batch}")

    def _rows(self, part: str, schema: str) -> DataFrame:
        if not [n for n in self.files.names(part) if n[0] not in "_."]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def taken(self) -> DataFrame:
        return self._rows("taken", "analysis_result_id string, path string, error string").where("error is null").select(*self.KEY).distinct()

    def waiting(self) -> DataFrame:
        rows = self._rows("waiting", "analysis_result_id string, path string, body string, batch int")
        return rows.groupBy(*self.KEY).agg(F.max_by("body", "batch").alias("body")).join(self.taken(), self.KEY, "left_anti")

    def deliver(self, send: Callable[[str, str], None]) -> None:
        """Sends what waits; what the receiver does not take waits on, and its error is kept."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for name, path, body in zip(pdf["analysis_result_id"], pdf["path"], pdf["body"], strict=True):
                    try:
                        send(path, body)
                        rows.append((name, path, None))
                    except Exception as e:
                        rows.append((name, path, str(e) or type(e).__name__))
                yield pd.DataFrame(rows, columns=["analysis_result_id", "path", "error"])

        sent = self.waiting().mapInPandas(run, "analysis_result_id string, path string, error string")
        sent.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.path}/taken")


def analysis_batch(store: ChunkStore, outbox: Outbox, pages_of: Callable[[DataFrame], DataFrame], rules: Rules, embed: Callable, send: Callable | None = None) -> Callable[[DataFrame, int], None]:
    """What a batch of requests does: chunks and vectors saved as one version, callbacks put into the outbox, then sent.

    A batch that is run again replaces the same documents and the same callbacks.
    Requests without an analysis_result_id, which no callback could name, are left out.
    """

    def run(batch: DataFrame, number: int) -> None:
        requests = store.staged(batch.where("analysis_result_id is not null").select(*REQUEST_FIELDS))
        if requests.limit(1).count():
            outbox.put(number, store.staged(analyse(requests, pages_of(requests), rules, embed, store)))
        if send:
            outbox.deliver(send)

    return run


def analysis_stream(spark: SparkSession, requests_dir: str, checkpoint: str, run: Callable[[DataFrame, int], None]):
    """analysis_batch() over arriving JSON files of requests, a line each."""
    schema = ", ".join(f"{f} string" for f in REQUEST_FIELDS)
    requests = spark.readStream.schema(schema).json(requests_dir)
    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
