"""The versioned store, vectors that survive a kill, downloads, and names of files."""

import json
import os
import re
import signal
import subprocess
import sys
import time
from pathlib import Path

import pytest
from lamina.functions import text as T
from lamina.operators import retrieval
from lamina.sources import files
from lamina.sources.progress import VectorProgress
from lamina.sources.store import ChunkStore, StoreConflict
from pyspark.sql import functions as F

CHUNKS = "doc_id string, chunk_id string, text string, user_id string, trip_id string, policy_id string, document_id string"


def saved(spark, store, docs, text="x", policy=lambda d: f"p{d}"):
    rows = [(d, f"{d}_{i}", f"{text} {d} {i}", "u", "t", policy(d), d) for d in docs for i in range(3)]
    vectors = [(d, f"{d}_{i}", [float(i + 1), float(len(d))]) for d in docs for i in range(2)]  # the third has none
    return store.save(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(vectors, "doc_id string, chunk_id string, vector array<float>"))


def texts(df):
    return sorted(r["text"] for r in df.collect())


def test_saves_replace_documents_in_chunks_and_vectors_at_once(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=3)
    with pytest.raises(FileNotFoundError):
        store.index()
    first = saved(spark, store, [f"d{i}" for i in range(9)])
    second = saved(spark, store, ["d1", "d2", "new"], "y")
    assert store.version() == 2 and len({first, second}) == 2
    want = sorted([f"x d{i} {k}" for i in (0, 3, 4, 5, 6, 7, 8) for k in range(3)] + [f"y {d} {k}" for d in ("d1", "d2", "new") for k in range(3)])
    assert texts(store.rows()) == want and store.index().count() == 20
    assert texts(store.rows(second)) == [w for w in want if w[0] == "y"]
    assert saved(spark, store, []) and store.version() == 2
    store.vacuum()
    assert texts(store.rows()) == want and store.version() == 2 and store.files.names("staged") == [] and store.files.names("manifests") == ["2.json"]
    assert saved(spark, store, ["d1"], "z") and texts(store.rows().where("doc_id = 'd1'")) == ["z d1 0", "z d1 1", "z d1 2"]


def test_a_failure_between_the_writes_shows_the_old_version(spark, tmp_path, monkeypatch):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=2)
    saved(spark, store, ["a", "b"])
    before = texts(store.rows())
    with monkeypatch.context() as m:
        m.setattr(ChunkStore, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            saved(spark, store, ["a", "c"], "y")
    assert texts(store.rows()) == before and store.version() == 1 and len(store.files.names("data")) == 2
    store.vacuum()
    assert texts(store.rows()) == before and len(store.files.names("data")) == 1


def test_two_saves_of_one_version_conflict(spark, tmp_path):
    store, other = (ChunkStore(spark, str(tmp_path / "s")) for _ in range(2))
    saved(spark, store, ["a"])
    old = store.manifest()
    saved(spark, other, ["b"])
    with pytest.raises(StoreConflict):
        store._commit(1, old)
    assert not store.files.create("manifests/2.json", "{}") and store.files.names("manifests") == ["1.json", "2.json"]
    assert json.loads(store.files.read("manifests/2.json"))["saves"] != old["saves"]


def test_a_question_reads_its_policy_only(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=8)
    saved(spark, store, [f"d{i}" for i in range(40)])
    asked = spark.createDataFrame([("pd7",), ("unknown",), (None,)], "policy_id string")
    rows = store.of_policies(asked)
    assert {r["doc_id"] for r in rows.collect()} == {"d7"} and rows.count() == 2
    opened = {Path(f).parent.name for f in rows.inputFiles()}
    assert len(opened) == 1 < len({Path(f).parent.name for f in store.rows().inputFiles()})
    pushed = re.search(r"PushedFilters: \[(.*?)\]", rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert "In(policy_id, [pd7,unknown" in pushed[1]
    assert store.of_policies(asked.where("policy_id = 'unknown'")).collect() == []
    many = spark.range(400).select(F.concat(F.lit("pd"), F.col("id").cast("string")).alias("policy_id"))
    assert store.of_policies(many).count() == 80
    question = spark.createDataFrame([(1, [1.0, 2.0], "pd7"), (2, [1.0, 2.0], "unknown")], "query_id long, query_vector array<float>, policy_id string")
    assert [(r["query_id"], r["id"]) for r in store.search(question).orderBy("rank").collect()] == [(1, "d7_0"), (1, "d7_1")]
    assert store.search(question, 5, scoped=False).count() == 10


EMBED = """
import sys, time, uuid, os
sys.path.insert(0, {root!r})
from lamina.sources.session import ready
from pyspark.sql import SparkSession
from lamina.sources.progress import VectorProgress
spark = ready(SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate())
def embed(texts):
    time.sleep(0.4)
    return [[float(len(t))] for t in texts]
rows = spark.range(600).selectExpr("concat('c', id) as chunk_id", "concat('text ', id) as text")
VectorProgress(spark, {table!r}, "chunk_id").run(rows, "text", embed, batch=10)
"""


def test_a_killed_run_asks_for_no_finished_batch_again(spark, tmp_path):
    table, seen = tmp_path / "vectors", tmp_path / "seen"
    seen.mkdir()
    script = tmp_path / "run.py"
    script.write_text(EMBED.format(root=str(Path(files.__file__).parents[2]), table=str(table)))
    run = subprocess.Popen([sys.executable, str(script)], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    until = time.time() + 120
    while len(list(table.glob("part-*"))) < 8 and run.poll() is None and time.time() < until:
        time.sleep(0.1)
    os.killpg(run.pid, signal.SIGKILL)
    run.wait()
    time.sleep(3)  # its workers notice
    progress = VectorProgress(spark, str(table), "chunk_id")
    done = {r["chunk_id"] for r in progress.finished().collect()}
    assert 0 < len(done) < 600
    folder = str(seen)

    def embed(texts):
        import uuid

        Path(folder, uuid.uuid4().hex).write_text("\n".join(texts))
        return [[float(len(t))] for t in texts]

    rows = spark.range(600).selectExpr("concat('c', id) as chunk_id", "concat('text ', id) as text")
    got = progress.run(rows.union(rows.limit(5)), "text", embed, batch=10)
    asked = [t for f in seen.iterdir() for t in f.read_text().split("\n")]
    assert sorted(asked) == sorted(f"text {i}" for i in range(600) if f"c{i}" not in done)
    assert got.count() == 600 and got.where("vector[0] <> length(chunk_id) + 4").count() == 0
    calls = len(list(seen.iterdir()))
    assert progress.run(rows, "text", embed, batch=10).count() == 600 and len(list(seen.iterdir())) == calls


def test_retries_wait_and_batches_are_full(spark, tmp_path):
    state = str(tmp_path / "failed")

    def embed(texts):
        assert len(texts) <= 50
        if not os.path.exists(state):
            Path(state).write_text(str(time.time()))
            raise OSError("busy")
        assert time.time() - float(Path(state).read_text()) >= 0.5
        return [[float(len(texts))] for _ in texts]

    rows = spark.range(130).coalesce(1).selectExpr("id", "'x' as text")
    progress = VectorProgress(spark, str(tmp_path / "v"), "id", "long")
    got = progress.run(rows, "text", embed, commit_every=3, wait=0.5)
    assert sorted({r["vector"][0] for r in got.collect()}, reverse=True) == [50.0, 30.0] and got.count() == 130
    assert progress.run(rows.limit(0), "text", embed).count() == 130


def test_downloads_are_streamed_to_files(spark, tmp_path):
    def parts(url):
        yield b"a" * 3
        if url == "bad":
            raise OSError("cut off")
        yield b"b" * 4

    asked = spark.createDataFrame([("d 1", "good"), ("x/y", "good"), ("d3", "bad")], "document_id string, download_url string")
    got = {r["document_id"]: r for r in files.saved_downloads(asked, str(tmp_path / "pdfs"), parts).collect()}
    assert got["d 1"]["n_bytes"] == 7 and Path(got["d 1"]["path"]).read_bytes() == b"aaabbbb" and got["d3"]["error"] == "cut off"
    assert sorted(p.name for p in (tmp_path / "pdfs").iterdir()) == ["d 1.pdf", "x%2Fy.pdf"]


def test_names_and_scopes(spark):
    rows = spark.createDataFrame([("/a/b/plan_v2_pages.json",), ("plan.pdf",), ("x_chunks.json",), ("e_embeddings.json",)], "path string")
    got = [tuple(r) for r in rows.select(T.source_pdf(F.col("path")), T.chunks_file(F.col("path")), T.document_stem(F.col("path"))).collect()]
    assert got == [("plan_v2.pdf", "plan_v2_chunks.json", "plan_v2"), ("plan.pdf", "plan.pdf", "plan"), ("x_chunks.json", "x_chunks.json", "x"), ("e_embeddings.json", "e_embeddings.json", "e")]
    hits = spark.createDataFrame([(None, "a/policy.v1.pdf"), ("", "b.pdf"), ("doc", "c.pdf"), (None, None)], "document_id string, source_file string")
    assert [r["document_id"] for r in retrieval.hit_rows(hits).collect()] == ["policy.v1", "b", "doc", None]
    assert retrieval.hit_rows(hits.drop("source_file")).where("document_id is null").count() == 3
    given = files.with_scope(hits.drop("document_id"), "u", "t", "p", "d").first()
    assert (given["user_id"], given["trip_id"], given["policy_id"], given["document_id"]) == ("u", "t", "p", "d")
