"""Vectors that are committed batch by batch, so that a run that was killed goes on where it ended.

Rows without a vector are dealt to tasks of `commit_every` model batches each. Spark
commits each task's file by itself as soon as the task ends (the second algorithm of
its file committer), so what a killed run leaves are whole files of whole batches,
and a rerun asks the model for the rest only. Retries may leave a file twice: a key
counts once when the table is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import embedded, pending
from .store import Files


class VectorProgress:
    """A table of vectors: key, vector, task (the number of its task in its run)."""

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str = "string"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = f"{key} {kind}, vector array<float>, task int"
        self.files = Files(spark, self.path)

    def finished(self) -> DataFrame:
        """(key, vector) of all batches committed so far."""
        if not any(n[0] not in "_." for n in self.files.names("")):
            return self.spark.createDataFrame([], self.schema).drop("task")
        return self.spark.read.schema(self.schema).parquet(self.path).drop("task").dropDuplicates([self.key])

    def run(self, rows: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 50, commit_every: int = 1, retries: int = 1, wait: float = 3.0) -> DataFrame:
        """finished() after the model has seen all rows (key, text) without a vector, each key once, in batches of `batch`.

        A batch that fails is tried again after `wait` seconds. commit_every: batches of
        a file; more make fewer files, and more to do again. Null keys are left out.
        """
        left = pending(rows.where(F.col(self.key).isNotNull()).select(self.key, text).dropDuplicates([self.key]), self.finished(), self.key)
        n_tasks = -(-left.count() // (batch * commit_every))
        if n_tasks:
            order = left.repartitionByRange(n_tasks, F.xxhash64(self.key), self.key).withColumn("task", F.spark_partition_id())
            made = embedded(order, self.key, text, embed, batch, retries, wait, keep=("task",))
            made.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.path)
        return self.finished()
