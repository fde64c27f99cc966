"""Settings, from environment variables or Spark's configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    store_path: str = "store"
    keyword_path: str = ""
    callback_url: str = ""
    top_k: int = 8
    embed_batch: int = 50
    download_seconds: float = 30.0
    callback_seconds: float = 10.0
    download_path: str = ""

    @classmethod
    def load(cls, spark: SparkSession | None = None) -> Settings:
        """LAMINA_TOP_K in the environment, or spark.lamina.top_k in the session, which comes first."""
        found = {}
        for f in fields(cls):
            value = spark.conf.get(f"spark.lamina.{f.name}", None) if spark else None
            value = value if value is not None else os.environ.get(f"LAMINA_{f.name.upper()}")
            if value is not None:
                found[f.name] = type(f.default)(value)
        return cls(**found)
