"""Targets, taken words and positions against brute force."""

import random

import pytest
from lamina.llm import source_mix as M
from lamina.llm.common import ready

SCHEMA = "doc_id long, text string, source string, size string, n_chars int, position double"


def brute_targets(sizes, weights=(1, 2, 3), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, left = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = epochs * sizes[s]
        left = sum(sizes.values()) - sum(fixed.values())


def rows(rng):
    out = []
    for i in range(300):
        source = rng.choice(["hot"] * 5 + ["a", "b", "é", "Z", "", None, "tiny"])
        words = rng.choice([0, 1, 5, 40, 300]) if source != "tiny" else 1
        out.append((i, rng.choice([" ".join(["w"] * words), "\t".join(["é"] * words) + "\n"]), source, "x", 7, 0.5))
    return [*out, (900, None, "a", "", 0, 0.0), (901, "w " * 5000, "b", "", 0, 0.0), (950, "dup dup", "Z", "", 0, 0.0), (950, "dup dup", "Z", "", 0, 0.0)]


def test_mix_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 7)
    data = rows(random.Random(4))
    docs = ready(spark).createDataFrame(data, SCHEMA)
    got = M.mix_report(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in data)
    size = lambda t: len((t or "").split())
    sizes = {}
    for _, text, source, *_ in data:
        sizes[source] = sizes.get(source, 0) + size(text)
    want, source_of = brute_targets(sizes), {d: s for d, _, s, *_ in data}
    taken = {}
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r["size"]
        assert (r.position is None) == (r.taken == 0)
        assert r.position is None or 0 <= r.position <= 1
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = {(r.doc_id, r.taken, r.position) for r in M.mix_report(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken, r.position) for r in got}


def test_positions_invert_the_integrated_schedule(spark):
    from pyspark.sql import functions as F

    for slope in (-0.5, 0.0, 0.5):
        t = spark.range(101).select(M.due_at(F.col("id") / 100, F.lit(slope)).alias("t"), (F.col("id") / 100).alias("c")).collect()
        assert all((1 - slope) * r.t + slope * r.t**2 == pytest.approx(r.c) for r in t)


def test_mixed_documents(spark):
    data = rows(random.Random(8))
    docs = ready(spark).createDataFrame(data, SCHEMA)
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = {}
    for r in out.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    want = {}
    for r in M.mix_report(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert taken == {d: n for d, n in want.items() if n}


def test_many_equal_rows_meet_the_target(spark):
    """A source of 1,000 equal rows of two words gets 2,666.7 of 4,000 words."""
    data = [(None, "two words", "a", "", 9, 0.0)] * 1000 + [(i, "w " * 20, "b", "", 40, 0.0) for i in range(100)]
    docs = ready(spark).createDataFrame(data, SCHEMA)
    got = M.mix_report(docs).collect()
    want = brute_targets({"a": 2000, "b": 2000})
    for name, rows in (("a", [r for r in got if r.doc_id is None]), ("b", [r for r in got if r.doc_id is not None])):
        assert abs(sum(r.taken for r in rows) - want[name]) <= 1 and all(r.taken <= 3 * r["size"] for r in rows)
    assert {r.taken for r in got if r.doc_id is None} == {1, 2}
    mixed = M.mixed_documents(docs).collect()
    assert abs(sum(len(r.text.split()) for r in mixed if r.source == "a") - want["a"]) <= 1


def test_empty(spark):
    empty = ready(spark).createDataFrame([], SCHEMA)
    assert M.mix_report(empty).collect() == [] and M.mixed_documents(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None, "", 0, 0.0), (2, "", "a", "", 0, 0.0)], SCHEMA)
    assert [(r["size"], r.target, r.taken) for r in M.mix_report(blank).collect()] == [(0, 0.0, 0)] * 2
