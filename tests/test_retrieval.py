"""Search, related evidence, prompts, stores and jobs."""

import difflib
import json
import random
from dataclasses import replace

import numpy as np
import pytest
from lamina.functions.rules import CORPUS
from lamina.operators import ingest, reports, retrieval, vectors
from lamina.sources import files
from pyspark.sql import functions as F

HIT = "query_id long, rank long, chunk_id string, document_id string, page_start long, page_end long, section_title string, coverage_type string, text string, related_chunk_id string, score double"


def hit(chunk, rank=1, query=1, related=None, **kw):
    row = {"document_id": "doc-1", "page_start": 10, "page_end": 10, "section_title": "제1조", "coverage_type": "included", "text": "본문"} | kw
    return (query, rank, chunk, row["document_id"], row["page_start"], row["page_end"], row["section_title"], row["coverage_type"], row["text"], related, 0.9)


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=6).tolist(), i % 3) for i in range(100)] + [(100, [0.0] * 6, 0), (101, [float("nan")] * 6, 0)]
    corpus = spark.createDataFrame(data, "id long, vector array<double>, scope int").repartition(7)
    asked = corpus.where("id in (3, 4, 100)").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), "scope")
    asked = asked.unionByName(spark.createDataFrame([(999, [1.0] * 6, 77)], asked.schema))
    for scope in (None, "scope"):
        got = {}
        for r in vectors.cosine_top_k(asked, corpus, 5, scope).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)
        for q, v, s in [(3, data[3][1], 0), (4, data[4][1], 1), (999, [1.0] * 6, 77)]:
            rows = [(i, x) for i, x, t in data if i != 101 and (scope is None or t == s)]
            cos = lambda x: float(np.dot(v, x) / (np.linalg.norm(v) * (np.linalg.norm(x) or 1)))  # noqa: E731, B023
            best = sorted(((-cos(x), i) for i, x in rows))[:5]
            assert [got.get(q, {})[k][0] for k in sorted(got.get(q, {}))] == [i for _, i in best]
        assert 100 not in got


def test_related_evidence(spark):
    chunks = spark.createDataFrame([hit(c) for c in ("covered", "exc", "two")], HIT)
    ids = lambda rows: [r.chunk_id for r in retrieval.with_related(spark.createDataFrame(rows, HIT), chunks).orderBy("rank").collect()]
    assert ids([hit("covered", related="exc")]) == ["covered", "exc"]
    assert ids([hit("covered", 1, related="exc"), hit("exc", 2)]) == ["covered", "exc"]
    assert ids([hit("a", 1, related="two"), hit("b", 2, related="exc"), hit("c", 3, related="two"), hit("d", 4, related="gone")]) == ["a", "b", "c", "d", "two", "exc"]


def test_prompt_blocks(spark):
    hits = spark.createDataFrame([hit("a", 1, page_end=12), hit("b", 2, coverage_type="excluded", text="가" * 500), hit("c", 3, coverage_type="odd")], HIT)
    text = retrieval.evidence(hits).collect()[0].evidence
    assert text.split("\n\n") == ["[근거 1] [보장] 제1조 (10~12p)\n본문", "[근거 2] [면책(보상하지 않음)] 제1조 (10p)\n" + "가" * 500, "[근거 3] [odd] 제1조 (10p)\n본문"]
    quotes = {r.chunk_id: r for r in retrieval.sources(hits).collect()}
    assert len(quotes["b"].quote) == 203 and quotes["b"].quote.endswith("...") and quotes["b"].page == 10
    one = spark.range(1)
    cover = F.array(F.struct(F.lit("A").alias("name"), F.lit(True).alias("subscribed"), F.lit(1234567).alias("limitAmount")), F.struct(F.lit("B").alias("name"), F.lit(False).alias("subscribed"), F.lit(None).cast("int").alias("limitAmount")))
    none = cover.__class__ and F.slice(cover, 1, 0)
    r = one.select(retrieval.contract_block(cover).alias("some"), retrieval.contract_block(none).alias("none")).first()
    assert r.some == "[가입 정보]\n- A: 가입 / 한도 1,234,567원\n- B: 미가입" and r.none == ""
    m = one.select(retrieval.user_message(F.lit(""), F.lit("h"), F.lit("e"), F.lit("q")).alias("m")).first().m
    assert m == "h\n\n[약관 근거]\ne\n\n[질문]\nq"
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "system", None)], "conv_id long, turn long, role string, text string")
    assert retrieval.history_blocks(turns).first().history == "[이전 대화]\n사용자: a\n어시스턴트: b\n어시스턴트: "


def test_answers(spark):
    questions = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id long, question string")
    hits = spark.createDataFrame([hit("a", related="b")], HIT)
    chunks = spark.createDataFrame([hit("a"), hit("b", text="나" * 300)], HIT)
    got = {r.query_id: r for r in retrieval.answers(questions, hits, chunks).collect()}
    assert got[2].answer == retrieval.NO_EVIDENCE and got[2].sources == []
    assert got[1].answer == "본문" and [s.chunkId for s in got[1].sources] == ["a", "b"] and len(got[1].sources[1].quote) == 203


def test_embedding_is_batched_retried_and_resumed(spark):
    rows = spark.createDataFrame([(i, f"word{i}") for i in range(120)], "id long, text string").coalesce(1)
    sizes = []

    def embed(texts, state={"failed": False}):  # noqa: B006
        if not state["failed"]:
            state["failed"] = True
            raise OSError
        assert len(texts) <= 50
        return [[float(len(t))] for t in texts]

    got = vectors.embedded(rows, "id", "text", embed)
    assert got.count() == 120 and sizes == []
    left = vectors.pending(rows, got.where("id < 100"), "id")
    assert left.count() == 20 and vectors.upsert(got.where("id < 100"), got, "id").count() == 120


def test_reports(spark):
    truth = [("t1", c) for c in ("alpha beta", "10 won", "gamma")] + [("t2", c) for c in ("x y z", "delta")] + [("t3", "none")]
    found = [
        ("t1", 0, "alpha\nbe ta\n10 won"), ("t1", 1, "10won gamma alphabeta"), ("t1", 2, "gamma10 wonalphabeta"),  # 2/3, then all, twice
        ("t2", 0, "zzz"), ("t2", 1, ""),
    ]
    best = reports.best_candidates(spark.createDataFrame(truth, "table_id string, cell string"), spark.createDataFrame(found, "table_id string, candidate int, text string"))
    got = {r.table_id: (round(r.recall, 6), r.candidate, r.n_candidates) for r in best.collect()}
    assert got == {"t1": (1.0, 1, 3), "t2": (0.0, 0, 2), "t3": (0.0, None, 0)}
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab c", k=rng.randint(0, 12))) for _ in range(80)]
    pairs = spark.createDataFrame([(i, texts[i], texts[-i - 1]) for i in range(80)], "i int, a string, b string")
    for r in pairs.select("a", "b", reports.containment(F.col("a"), F.col("b")).alias("ratio")).collect():
        a, b = r.a.replace(" ", ""), r.b.replace(" ", "")
        blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        assert r.ratio == (1.0 if not a else 0.0 if not b else sum(x.size for x in blocks) / len(a))
    assert reports.share("", "x") == 1.0 and reports.share("x", "") == 0.0
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 40))) for _ in range(2))
        assert reports.shared_chars(a, b) == sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    none = reports.chunk_summary(spark.createDataFrame([], "matched_category string")).first()
    assert none.total == 0 and none.matched_share is None


def test_store_and_job(spark, tmp_path):
    pages = spark.createDataFrame([(d, 1, "\n".join([f"{d} title", *[f"line {i} of thanedble words in here" for i in range(20)]])) for d in ("a", "b")], "doc_id string, page long, text string")
    store = files.ChunkStore(spark, str(tmp_path / "store"))
    requests = spark.createDataFrame([("r1", "a", "u", "me", "trip", "pol"), ("r2", "gone", "u", "me", "trip", "pol"), ("r3", "b", "u", "me", None, "pol")], "analysis_result_id string, document_id string, download_url string, user_id string, trip_id string, policy_id string")
    status = {r.analysis_result_id: r for r in ingest.analyse(requests, pages, CORPUS, vectors.hashing_embedder(), store).collect()}
    assert [status[k].path for k in ("r1", "r2", "r3")] == ["complete", "fail", "fail"]
    body = json.loads(status["r1"].body)
    assert body["status"] == "COMPLETED" and body["coverageItems"][0]["coverageStatus"] == "included"
    chunks = store.index()
    assert {r.doc_id for r in chunks.select("doc_id").collect()} == {"a"} and chunks.where("user_id <> 'me' or document_id <> 'a'").count() == 0
    n = chunks.count()
    store.save(*(chunks.select([c for c in chunks.columns if c != "vector"]).withColumn("doc_id", F.lit("z")), chunks.select(F.lit("z").alias("doc_id"), "chunk_id", "vector")))
    assert store.index().groupBy("doc_id").count().count() == 2 and store.index().where("doc_id = 'a'").count() == n
    question = chunks.select(F.lit(1).cast("long").alias("query_id"), F.col("vector").alias("query_vector"), F.lit("pol").alias("policy_id")).limit(1)
    assert store.search(question).count() >= 1 and store.search(question.withColumn("policy_id", F.lit("unknown"))).count() == 0
    sent = files.post_payloads(spark.createDataFrame([("complete", "{}")], "path string, body string"), None).first()
    assert not sent.sent and sent.error is None


def test_json_sources(spark, tmp_path):
    for name, content in (("a_pages.json", [{"page": 1, "text": "가"}]), ("b.json", [{"page": 1, "text": "b"}, {"page": 2, "text": None}])):
        (tmp_path / name).write_text(json.dumps(content), encoding="utf-8")
    got = files.read_json(spark, f"{tmp_path}/*.json", files.PAGES)
    assert sorted((r.doc_id, r.page) for r in got.collect()) == [("a_pages", 1), ("b", 1), ("b", 2)]
    with pytest.raises(FileNotFoundError):
        files.read_json(spark, f"{tmp_path}/*.none", files.PAGES)
    (tmp_path / "empty.json").write_text("")
    with pytest.raises(files.EmptyFile):
        files.read_json(spark, f"{tmp_path}/empty.json", files.PAGES)
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_json(spark, f"{tmp_path}/bad.json", files.PAGES).collect()
    files.read_json(spark, f"{tmp_path}/bad.json", files.PAGES, strict=False).collect()
    (tmp_path / "v.json").write_text(json.dumps({"c1": [1.0, 2.0], "c2": [0.5, 0.5]}))
    assert {(r.chunk_id, tuple(r.vector)) for r in files.read_vectors(spark, f"{tmp_path}/v.json").collect()} == {("c1", (1.0, 2.0)), ("c2", (0.5, 0.5))}
    files.write_json(got, str(tmp_path / "out"))
    (tmp_path / "x.pdf").write_bytes(b"pdf")
    decoded = files.read_pdfs(spark, f"{tmp_path}/*.pdf", lambda b: [{"page": 1, "block_idx": 0, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "text": b.decode(), "block_type": 0, "page_w": 1.0, "page_h": 1.0}])
    assert [(r.doc_id, r.text, r.error) for r in decoded.collect()] == [("x", "pdf", None)]
    assert files.read_pdfs(spark, f"{tmp_path}/*.pdf", lambda b: 1 / 0).first().error


def test_stream(spark, tmp_path):
    from lamina.streaming.jobs import chunk_stream

    pages = [("d1", 1, "\n".join(f"line {i} with some words in it for length" for i in range(9)))]
    spark.createDataFrame(pages, "doc_id string, page int, text string").write.parquet(str(tmp_path / "in"))
    rules = replace(CORPUS, small=10)
    chunk_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), rules).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 1


def test_validation_and_names(spark):
    random.seed(1)
    df = spark.createDataFrame([("a", None), ("b", "c")], "user_id string, trip_id string")
    assert [r.ok for r in df.select(ingest.valid(df, ("user_id", "trip_id")).alias("ok")).collect()] == [False, True]
    assert ingest.camel_case(df).columns == ["userId", "tripId"]


def test_evaluation_of_two_methods(spark):
    tables = spark.createDataFrame(
        [("t1", "p", 2, ["a", "b"], [["alpha beta", "10 won"], ["gamma", "delta"]]), ("t2", "p", 3, ["a"], [["abcdefghij"]]), ("t3", "q", 1, ["a"], [["x"]])],
        "table_id string, pdf string, page int, columns array<string>, rows array<array<string>>",
    )
    pages = spark.createDataFrame([("p", 1, "other"), ("p", 2, "alphabeta 10won\ngamma"), ("p", 3, "abcd--efg"), ("p", 4, "")], "pdf string, page int, text string")
    timings = spark.createDataFrame([("p", 2.0)], "pdf string, seconds double")
    one = lambda rows, n, m: (rows, n, m)
    results = spark.createDataFrame(
        [("t1", 5.0, [one([["alpha", "zz"]], 1, 2), one([["alphabeta", "10won"], ["delta", None]], 2, 2), one([["delta", "10 won", "alpha beta"]], 1, 3)]), ("t2", 6.0, [])],
        "table_id string, seconds double, candidates array<struct<rows:array<array<string>>,detected_rows:int,detected_cols:int>>",
    )
    got = {r.table_id: r for r in reports.evaluation(tables, pages, timings, results).collect()}
    row = got["t1"]
    assert (row.truth_cells, row.truth_rows, row.truth_cols, row.layout_recall, row.model_recall) == (4, 2, 2, 0.75, 0.75)
    assert (row.layout_seconds_per_page, row.model_seconds, row.n_candidates, row.detected_rows, row.detected_cols) == (0.5, 5.0, 3, 2, 2)
    assert (got["t2"].layout_recall, got["t2"].model_recall, got["t2"].n_candidates) == (1.0, 0.0, 0)  # seven of ten characters
    assert (got["t3"].layout_recall, got["t3"].model_recall, got["t3"].model_seconds, got["t3"].layout_seconds_per_page) == (0.0, 0.0, None, None)


def test_answers_with_contract_and_history(spark):
    hits = spark.createDataFrame(
        [(1, 1, "c", "d", 3, 3, "title", "included", "what the policy says", None, 0.5)],
        "query_id long, rank long, chunk_id string, document_id string, page_start long, page_end long, section_title string, coverage_type string, text string, related_chunk_id string, score double",
    )
    asked = spark.createDataFrame([(1, "how much?", [("bags", True, 5000)], "[before]")], "query_id long, question string, contract array<struct<name:string,subscribed:boolean,limitAmount:bigint>>, history string")
    whole = retrieval.answers(asked, hits, hits.drop("query_id", "rank", "score"), lambda message: retrieval.chat_request(message, "be brief", "m")).first()
    request = json.loads(whole.answer)
    assert request["temperature"] == 0 and request["model"] == "m" and [m["role"] for m in request["messages"]] == ["system", "user"]
    told = request["messages"][1]["content"]
    assert request["messages"][0]["content"] == "be brief"
    assert [told.index(x) for x in ("bags: ", "5,000", "[before]", "what the policy says", "how much?")] == sorted(told.index(x) for x in ("bags: ", "5,000", "[before]", "what the policy says", "how much?"))


def test_vectors_that_are_null_or_of_unlike_length(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0, 5.0]), (5, [0.0, None]), (6, [0.6, 0.8])]
    corpus = spark.createDataFrame(rows, "id long, vector array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query_vector array<float>")
    got = [(r.id, round(r.score, 6)) for r in vectors.cosine_top_k(asked, corpus, 8).orderBy("rank").collect()]
    assert got == [(1, 1.0), (3, 1.0), (6, 0.6), (4, 0.0)]
