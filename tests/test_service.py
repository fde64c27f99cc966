"""Requests and responses, job order and failures, with stand-ins for models and networks."""

import json

import pytest
from lamina.functions.rules import CORPUS
from lamina.operators import retrieval, vectors
from lamina.plans import service as S
from lamina.plans.settings import Settings
from lamina.sources.files import ChunkStore

REQUEST = {"analysisResultId": "r", "documentId": "doc-1", "downloadUrl": "u", "userId": "me", "tripId": "t", "policyId": "p"}
QUESTION = {"userId": "me", "tripId": "t", "policyId": "p", "question": "thanedble words"}


def pages(spark, doc="doc-1"):
    text = "\n".join(["a title", *[f"line {i} of thanedble words in this place" for i in range(20)]])
    return spark.createDataFrame([(doc, 1, text)], "doc_id string, page long, text string")


@pytest.fixture
def service(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    return S.Service(spark, store, CORPUS, vectors.hashing_embedder(), lambda r: pages(spark))


def test_health_and_validation(service):
    assert service.health() == (200, {"status": "ok"})
    assert service.start_analysis(REQUEST) == (202, {"analysisResultId": "r", "status": "ACCEPTED"})
    assert service.start_analysis({k: v for k, v in REQUEST.items() if k != "tripId"}) == (422, {"missing": ["tripId"]})
    assert service.query_policy({"question": "x"})[0] == 422


def test_save_then_answer(service):
    done = service.run_analysis(REQUEST)
    assert done["status"] == "COMPLETED" and done["coverageItems"]
    stored = service.store.index().first()
    assert (stored.user_id, stored.trip_id, stored.policy_id, stored.document_id) == ("me", "t", "p", "doc-1")
    status, answer = service.query_policy(QUESTION)
    assert status == 200 and answer["answer"] and answer["sources"][0]["documentId"] == "doc-1"
    assert set(answer["sources"][0]) == {"chunkId", "documentId", "page", "quote"}
    assert service.query_policy(QUESTION | {"policyId": "other"}) == (200, {"answer": retrieval.NO_EVIDENCE, "sources": []})


def test_failures(service):
    service.pages_of = lambda r: 1 / 0
    failed = service.run_analysis(REQUEST)
    assert failed["status"] == "FAILED" and "zero" in failed["errorMessage"]

    def refuses(path, body):
        raise OSError("no answer")

    service.send = refuses
    assert service.run_analysis(REQUEST)["status"] == "FAILED"
    assert service.query_policy(QUESTION)[0] == 500  # nothing stored yet


def test_runner_and_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"x")
    block = {"page": 1, "block_idx": 0, "x0": 0.0, "y0": 300.0, "x1": 90.0, "y1": 310.0, "block_type": 0, "page_w": 100.0, "page_h": 800.0}
    lines = "\n".join(f"line {i} of some thanedble words here" for i in range(5))
    chunks = S.run_documents(spark, f"{tmp_path}/*.pdf", lambda b: [block | {"text": lines}], CORPUS, str(tmp_path / "out"))
    assert [r.chunk_id for r in chunks.collect()] == ["a_0001"] and spark.read.json(str(tmp_path / "out/chunks")).count() == 1
    with pytest.raises(ValueError, match="a: "):
        S.run_documents(spark, f"{tmp_path}/*.pdf", lambda b: 1 / 0, CORPUS, str(tmp_path / "out2"))
    monkeypatch.setenv("LAMINA_TOP_K", "3")
    assert Settings.load().top_k == 3 and Settings.load(spark).top_k == 3 and S.open_store(spark, Settings.load()).path == "store"
    (tmp_path / "k.json").write_text(json.dumps({"word": "cat"}))
    assert S.rules_for(Settings(keyword_path=str(tmp_path / "k.json"))).keywords[0].primary == "cat"


def test_a_document_that_gives_nothing_now_fails(service, spark):
    assert service.run_analysis(REQUEST)["status"] == "COMPLETED"
    service.pages_of = lambda r: pages(spark).limit(0)
    assert service.run_analysis(REQUEST)["status"] == "FAILED"


def test_callback_sender():
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    from lamina.sources.files import CallbackError, http_sender

    got = []

    class Receiver(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(200 if self.path.endswith("complete") else 500)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Receiver)
    Thread(target=server.serve_forever, daemon=True).start()
    send = http_sender(f"http://127.0.0.1:{server.server_port}/", 5)
    send("results/1/complete", '{"a": 1}')
    with pytest.raises(CallbackError):
        send("/results/1/fail", "{}")
    server.shutdown()
    assert got == [("/results/1/complete", {"a": 1}), ("/results/1/fail", {})] and http_sender("") is None


def test_a_service_of_settings_downloads_and_calls_back(spark, tmp_path):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    got = []

    class Both(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/file" else 404)
            self.end_headers()
            self.wfile.write(b"thanedble")

        def do_POST(self):
            got.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Both)
    Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    block = {"page": 1, "block_idx": 0, "x0": 0.0, "y0": 300.0, "x1": 90.0, "y1": 310.0, "block_type": 0, "page_w": 100.0, "page_h": 800.0}
    lines = "\n".join(f"line {i} of some {{}} words here" for i in range(5))
    decode = lambda content: [block | {"text": lines.replace("{}", content.decode())}]
    settings = Settings(store_path=str(tmp_path / "store"), callback_url=base, top_k=2, embed_batch=1)
    made = S.service_of(spark, settings, vectors.hashing_embedder(), decode, CORPUS)
    assert made.run_analysis(REQUEST | {"documentId": "a/b.c", "downloadUrl": f"{base}/file"})["status"] == "COMPLETED"
    assert [r.document_id for r in made.store.index().collect()] == ["a/b.c"]
    assert made.run_analysis(REQUEST | {"downloadUrl": f"{base}/none"})["status"] == "FAILED"
    server.shutdown()
    assert [(path, body["status"]) for path, body in got] == [("/complete", "COMPLETED"), ("/fail", "FAILED")] and (made.top_k, made.embed_batch) == (2, 1)
