"""What a session needs before Python workers run this package's functions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of an Arrow batch: texts may be long, and a batch is in a Python worker's memory as a whole.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> SparkSession:
    """A session whose workers import this package, where only the driver's path has it, and take small batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env.get('PYTHONPATH', '')}".strip(":")
    return spark
