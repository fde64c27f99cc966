"""Fingerprints, neighbours and the block tables against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from lamina.llm import text_fingerprints as T
from pyspark.sql import functions as F
from lamina.llm.common import ready

SCHEMA = "doc_id long, text string, fp string, bucket int, n string"


def brute_fp(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    terms = [f"{a} {b}" for a, b in zip(words, words[1:])] or words
    votes, total = [0] * 64, 0
    for t in terms:
        w = 1 + min(len(t), 28) // 4
        h = xxhash.xxh64(t.encode(), seed=42).intdigest()
        total += w
        for b in range(64):
            votes[b] += w * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def corpus(rng):
    words = [f"w{i}é" for i in range(50)] + ["The", "😀"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 30, 80]))) for _ in range(120)]
    texts += [t + " tail" for t in texts[:20]] + texts[:20] + [None, "", " \n", "x" * 5000, "hot copy " * 4000]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("rows_a_bucket", [1500, 9])
def test_report_against_brute_force(spark, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(T, "BUCKET_ROWS", rows_a_bucket)
    data = [(i * 50 - 300, t, "x", 1, "y") for i, t in enumerate(corpus(random.Random(1)))]
    docs = ready(spark).createDataFrame(data, SCHEMA)
    got = {r.doc_id: r for r in T.fingerprint_report(docs, F.col("doc_id") % 100 == 0).collect()}
    assert len(got) == len(data)
    prints = {d: brute_fp(t or "") for d, t, *_ in data}
    for i, (d, t, *_) in enumerate(data):
        t, follow = t or "", data[(i + 1) % len(data)]
        half = len(t) // 2
        edited = t[: len(t) - half] + (follow[1] or "")[:half]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert int(r.fingerprint, 16) == prints[d] and int(r.edited_fingerprint, 16) == brute_fp(edited)
        assert r.near_edited == 1 - (prints[d] ^ brute_fp(edited)).bit_count() / 64
        assert r.near_next == 1 - (prints[d] ^ prints[follow[0]]).bit_count() / 64
        near = sum((prints[d] ^ p).bit_count() <= 3 for e, p in prints.items() if e != d)
        assert r.n_near == (near if d % 100 == 0 else None)


def test_block_tables_find_all(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    for x in list(base):
        for k in (1, 2, 3, 4):
            base.append(x ^ sum(1 << b for b in rng.sample(range(64), k)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in base], "fp long")
    got = [(r.query, r.fp) for r in T.within_radius(df, df.limit(200)).collect()]
    queries = {r.fp for r in df.limit(200).collect()}
    want = {(a, signed(b)) for a in queries for b in set(base) if ((a % (1 << 64)) ^ b).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_few_repeated_and_null_rows(spark):
    one = ready(spark).createDataFrame([(4, "a b", "", 0, "")], SCHEMA)
    assert [r.near_next for r in T.fingerprint_report(one, F.col("doc_id") % 100 == 0).collect()] == [1.0]
    assert T.fingerprint_report(one.limit(0), F.col("doc_id") % 100 == 0).collect() == []
    some = spark.createDataFrame([(None, "a b", "", 0, ""), (4, "a b", "", 0, ""), (4, "a b", "", 0, ""), (4, None, "", 0, "")], SCHEMA)
    assert sorted(r.n_chars for r in T.fingerprint_report(some, F.col("doc_id") % 100 == 0).collect()) == [0, 3, 3, 3]


def test_many_rows_without_doc_id(spark, monkeypatch):
    monkeypatch.setattr(T, "BUCKET_ROWS", 4)
    texts = [f"w{i} x{i * i}" for i in range(300)]
    data = [(None, t) for t in texts] + [((1 << 60) + i, f"z{i}") for i in range(20)]
    got = T.fingerprint_report(ready(spark).createDataFrame(data, "doc_id long, text string"), F.col("doc_id") % 100 == 0).collect()
    assert sorted((r.doc_id or 0) for r in got) == sorted((i or 0) for i, _ in data)
    prints = {f"{brute_fp(t):016x}": t for t in texts}
    halves = {hashlib.sha256((t[: len(t) - len(t) // 2] + o[: len(t) // 2]).encode()).hexdigest(): (t, o) for t in texts for o in [*texts, "z0"]}
    followed = [halves[r.edited_sha256][1] for r in got if r.doc_id is None]
    assert all(halves[r.edited_sha256][0] == prints[r.fingerprint] or len(prints[r.fingerprint]) < 4 for r in got if r.doc_id is None)
    assert len(set(followed)) > 10  # an order without rows lost
