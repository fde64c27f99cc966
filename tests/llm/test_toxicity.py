"""The machine against its definition, and held-out accuracy."""

import random
import zlib

import numpy as np
from lamina.llm import toxicity as T
from lamina.llm.common import ready


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = T.Machine(np.arange(10, 30), 0.3, rng.normal(size=20), rng.normal(size=(20, T.FACTORS)))
    found = np.array([1, 10, 12, 19, 29, 99], dtype=np.uint32)
    at = [0, 2, 9, 19]
    want = 0.3 + sum(m.w[i] for i in at) + sum(m.v[i] @ m.v[j] for k, i in enumerate(at) for j in at[k + 1 :])
    assert abs(m.margin(found) - want) < 1e-9
    assert abs(T.Machine.load(m.dump()).margin(found) - want) < 1e-9


def test_learns_pairs_that_linear_weights_miss():
    rng = random.Random(2)

    def draw(n):
        rows, labels = [], []
        for _ in range(n):
            one, two = rng.random() < 0.8, rng.random() < 0.3
            words = [f"w{rng.randint(0, 300)}" for _ in range(10)] + ["one"] * one + ["two"] * two
            rows.append(np.sort(T.terms(" ".join(words))))
            labels.append(float(one != two))
        return rows, np.array(labels)

    m = T.fit(*draw(6000))
    rows, labels = draw(1000)
    right = np.mean([(m.margin(r) >= 0) == y for r, y in zip(rows, labels)])
    assert right > 0.95  # no sum of single weights exceeds 0.86
    at = m.at[[T._terms_of_word(w)[0] for w in ("one", "two")]]
    assert m.v[at[0]] @ m.v[at[1]] < -1


def test_trained_machine_is_that_of_all_terms(spark):
    """Counting terms first and fitting the kept ones gives what fitting whole term lists does."""
    rng = random.Random(5)
    data = []
    for i in range(600):
        bad = rng.random() < 0.3
        data.append((i, " ".join(rng.choices([f"word{k}" for k in range(400)], k=30) + (["stupid"] if bad else []) + (["folk"] if rng.random() < 0.3 else [])), int(bad)))
    docs = ready(spark).createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    got = T.Machine.load(T.train(docs, labels))
    told = [(T.terms(t), y) for i, t, y in data if zlib.crc32(str(i).encode()) % 5]
    want = T.fit([x for x, _ in told], np.array([float(y) for _, y in told]))
    assert got.kept.tolist() == want.kept.tolist() and len(want.kept)
    scored = {r.doc_id: r.score for r in T.scored(docs, T.train(docs, labels)).collect()}
    for i, t, _ in data[:50]:
        margin = got.margin(T.terms(t))
        assert abs(scored[i] - 1 / (1 + np.exp(-margin))) < 1e-9 and abs(margin - want.margin(T.terms(t))) < 2


def test_report_on_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (ready(spark).read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in T.toxicity_report(docs, labels).collect()}
    told = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[r.doc_id].held_out for r in told)
    positive = [got[r.doc_id].score for r in told if r.toxic]
    negative = [got[r.doc_id].score for r in told if not r.toxic]
    auc = np.mean([np.mean(p > np.array(negative)) + np.mean(p == np.array(negative)) / 2 for p in positive])
    assert auc > 0.95
    assert np.mean([s >= 0.5 for s in positive]) > 0.8 and np.mean([s >= 0.5 for s in negative]) < 0.02


def test_defined_cases(spark):
    schema = "doc_id long, text string, score string, toxic int"
    docs = ready(spark).createDataFrame([(1, None, "", 1), (2, "", "", 0), (None, "x", "", 0), (2, "", "", 0), (3, "a " * 100_000, "", 0)], schema)
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    assert len(T.toxicity_report(docs, labels).collect()) == 5
    assert len(T.toxicity_report(docs, labels.limit(0)).collect()) == 5
    assert T.toxicity_report(docs.limit(0), labels).collect() == []
