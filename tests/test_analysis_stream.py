"""Requests as a stream: a batch that runs again tells no one twice."""

import json
import uuid
from pathlib import Path

from lamina.functions.rules import CORPUS
from lamina.operators.ingest import REQUEST_FIELDS
from lamina.operators.vectors import hashing_embedder
from lamina.sources.store import ChunkStore
from lamina.streaming.jobs import Outbox, analysis_batch, analysis_stream
from pyspark.sql import functions as F


def request(name, doc, **other):
    return dict.fromkeys(REQUEST_FIELDS, "u") | {"analysis_result_id": name, "document_id": doc} | other


def test_batches_that_run_again_send_nothing_twice(spark, tmp_path):
    sent, refused = tmp_path / "sent", tmp_path / "refused"
    (tmp_path / "in").mkdir(), sent.mkdir(), refused.write_text("")
    folder, closed = str(sent), str(refused)

    def send(path, body):
        name = json.loads(body)["analysisResultId"]
        if name == "r2" and Path(closed).exists():
            raise OSError("closed")
        Path(folder, f"{path}-{name}-{uuid.uuid4().hex}").write_text(body)

    def pages_of(requests):
        text = F.concat_ws("\n", F.lit("a title"), *[F.lit(f"line {i} of thanedble words in this place") for i in range(20)])
        return requests.where("document_id <> 'gone'").select(F.col("document_id").alias("doc_id"), F.lit(1).cast("long").alias("page"), text.alias("text")).distinct()

    def names():
        return sorted(f.name.rsplit("-", 1)[0] for f in sent.iterdir())

    store, outbox = ChunkStore(spark, str(tmp_path / "store"), buckets=2), Outbox(spark, str(tmp_path / "outbox"))
    run = analysis_batch(store, outbox, pages_of, CORPUS, hashing_embedder(), send)
    first = [request("r1", "a"), request("r2", "b"), request("r3", "gone"), request("r4", "a", user_id=None), request(None, "a")]
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(r) for r in first))
    analysis_stream(spark, str(tmp_path / "in"), str(tmp_path / "check"), run).awaitTermination()
    assert names() == ["complete-r1", "fail-r3", "fail-r4"] and {r["analysis_result_id"] for r in outbox.waiting().collect()} == {"r2"}
    refused.unlink()
    (tmp_path / "in/2.json").write_text(json.dumps(request("r5", "c")))
    analysis_stream(spark, str(tmp_path / "in"), str(tmp_path / "check"), run).awaitTermination()
    told = ["complete-r1", "complete-r2", "complete-r5", "fail-r3", "fail-r4"]
    assert names() == told and outbox.waiting().count() == 0
    rows = store.index().count()
    analysis_stream(spark, str(tmp_path / "in"), str(tmp_path / "other-check"), run).awaitTermination()  # all files again, as one batch
    assert names() == told and store.index().count() == rows and {r["doc_id"] for r in store.index().select("doc_id").collect()} == {"a", "b", "c"}
