"""Versioned chunks and vectors: hash buckets of documents, and a manifest that switches all of them at once.

Layout under a store's path:

    data/<id>/bucket=<b>/...   rows of bucket b as of one save, in order of policy
    policies/<id>/...          (bucket, policy_id) of that save's buckets
    manifests/<n>.json         version n: the save that holds each bucket

A save writes its documents' rows, then the buckets that they are in anew, with
what these held of other documents, and last the manifest. Readers take the latest
manifest, so they see all of a save or nothing of it; what a failed save has
written is not read by anyone, and goes with vacuum().
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Policies at most that are a filter for the scan; more are joined.
FILTERED = 100


class StoreConflict(RuntimeError):
    """Another save has made the version that this one was to make."""


class Files:
    """What a store needs of a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file is there now by this call: it appears whole, and never replaces another."""
        folder, _, file = name.rpartition("/")
        draft = f"{folder}/_{file}-{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        done = not self.fs.exists(self.path(name)) and self.fs.rename(self.path(draft), self.path(name))
        if not done:
            self.fs.delete(self.path(draft), False)
        return bool(done)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class ChunkStore:
    """Chunks with their vectors by document; saving a document replaces it, in chunks and vectors at once."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """buckets: of a new store; one that is there keeps its own number."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.files = Files(spark, self.path)

    # Versions

    def version(self) -> int:
        """The latest, 0 if nothing is saved."""
        return max([int(n.removesuffix(".json")) for n in self.files.names("manifests") if n[0] != "_"], default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            raise FileNotFoundError(f"{self.path} holds no chunks yet")
        return json.loads(self.files.read(f"manifests/{version}.json"))

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all versions but the last ones, and what no version reads. No save may run meanwhile."""
        versions = range(1, self.version() + 1)
        live = {i for v in versions[-keep:] for i in self.manifest(v)["saves"].values()}
        for v in versions[:-keep]:
            self.files.delete(f"manifests/{v}.json")
        for folder in ("data", "policies", "staged"):
            for name in self.files.names(folder):
                if name not in live:
                    self.files.delete(f"{folder}/{name}")

    # Saving

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(buckets)).cast("int")

    def staged(self, rows: DataFrame) -> DataFrame:
        """rows, written under the store's path until the next vacuum: so what makes them runs once."""
        name = f"staged/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def save(self, chunks: DataFrame, vectors: DataFrame) -> str:
        """chunks, and vectors (doc_id, chunk_id, vector) of all or some of them; documents without chunks are left as they are. The save's id, as rows have it in save_id."""
        from .files import with_local_scope

        base, save_id = self.version(), uuid.uuid4().hex
        old = self.manifest(base) if base else {"buckets": self.buckets, "saves": {}}
        rows = with_local_scope(chunks.join(vectors.select("doc_id", "chunk_id", "vector"), ["doc_id", "chunk_id"], "left"))
        new = self.staged(rows.withColumns({"save_id": F.lit(save_id), "bucket": self.bucket(old["buckets"])}))
        touched = [str(r[0]) for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
        if not touched:
            return save_id
        held = [b for b in touched if b in old["saves"]]
        if held:
            before = self._read(old, held).withColumn("bucket", self.bucket(old["buckets"]))
            new = before.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)
        # a large bucket becomes several files, each in order of policy, so that a scan skips the others
        new.hint("rebalance", "bucket").sortWithinPartitions("bucket", "policy_id", "doc_id").write.partitionBy("bucket").parquet(f"{self.path}/data/{save_id}")
        written = self.spark.read.parquet(f"{self.path}/data/{save_id}")
        written.select("bucket", "policy_id").distinct().write.parquet(f"{self.path}/policies/{save_id}")
        self._commit(base, old | {"saves": old["saves"] | dict.fromkeys(touched, save_id)})
        return save_id

    def _commit(self, base: int, manifest: dict) -> None:
        if self.version() != base or not self.files.create(f"manifests/{base + 1}.json", json.dumps(manifest)):
            raise StoreConflict(f"{self.path}: version {base + 1} was saved meanwhile")

    # Reading

    def _read(self, manifest: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.path}/data/{manifest['saves'][b]}/bucket={b}" for b in buckets]
        return self.spark.read.option("mergeSchema", True).parquet(*paths)

    def rows(self, save_id: str | None = None) -> DataFrame:
        """All chunks, with vectors where there are some; or those of one save that are still the latest."""
        manifest = self.manifest()
        held = [b for b, s in manifest["saves"].items() if save_id in (None, s)]
        found = self._read(manifest, held or list(manifest["saves"])[:1])
        return found if save_id is None else found.where(F.col("save_id") == save_id)

    def index(self) -> DataFrame:
        """Chunks with their vectors, scope filled in; chunks without a vector are left out."""
        return self.rows().where("vector is not null").drop("save_id")

    def of_policies(self, asked: DataFrame) -> DataFrame:
        """index() of the policies of asked (policy_id) only: the other buckets' files are not opened, nor row groups of other policies."""
        manifest = self.manifest()
        wanted = asked.where("policy_id is not null").select("policy_id").distinct()
        named = [r[0] for r in wanted.limit(FILTERED + 1).collect()]
        saves = sorted(set(manifest["saves"].values()))
        live = F.concat_ws("/", F.col("save"), F.col("bucket").cast("string")).isin([f"{s}/{b}" for b, s in manifest["saves"].items()])
        kept = self.spark.read.parquet(*[f"{self.path}/policies/{s}" for s in saves]).withColumn("save", F.element_at(F.split(F.input_file_name(), "/"), -2))
        found = kept.where(live).join(wanted, "policy_id", "left_semi").select("bucket").distinct()
        held = [str(r[0]) for r in found.collect()]  # as many as there are buckets at most
        rows = self._read(manifest, held or list(manifest["saves"])[:1]).where("vector is not null").drop("save_id")
        if len(named) <= FILTERED:
            return rows.where(F.col("policy_id").isin(named) if named else F.lit(False))
        return rows.join(wanted, "policy_id", "left_semi")

    def by_ids(self, ids: DataFrame) -> DataFrame:
        from ..operators.retrieval import by_ids

        return by_ids(ids, self.index())

    def search(self, queries: DataFrame, k: int = 8, scoped: bool = True) -> DataFrame:
        """k nearest chunks of each of queries (query_id, query_vector, policy_id), of its policy if scoped; an unknown policy finds none."""
        from ..operators.vectors import cosine_top_k

        corpus = (self.of_policies(queries) if scoped else self.index()).select(F.col("chunk_id").alias("id"), "vector", "policy_id")
        return cosine_top_k(queries, corpus, k, "policy_id" if scoped else None)
