"""Exact top-k against brute force."""

import random

import numpy as np
from lamina.llm import mtree_search as M
from lamina.llm.common import ready

SCHEMA = "vec_id long, embedding array<float>, score string, vec string"


def brute(rows, queries, k):
    usable = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in usable), default=0)
    usable = [(i, np.pad(v, (0, width - len(v)))) for i, v in usable]
    out = []
    for n, (i, v) in enumerate(usable):
        if queries(i):
            best = sorted((-int(v @ w), j) for m, (j, w) in enumerate(usable) if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "PAGE", 64)
    monkeypatch.setattr(M, "LEAF", 8)
    monkeypatch.setattr(M, "PIVOTS", 5)
    monkeypatch.setattr(M, "PAGES_AT_ONCE", 1)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + 0.05 * rng.normal(size=8))], "a", "b") for i in range(400)]
    rows += [(1000 + i, rows[3][1], "a", "b") for i in range(120)]  # one vector many times
    rows += [(50, None, "", ""), (100, [1.0, None], "", ""), (150, [float("nan")] * 8, "", ""), (200, [float("inf")] * 8, "", "")]
    rows += [(2000, [1.0, 2.0], "", ""), (2050, [], "", ""), (None, [1.0] * 8, "", ""), (10, rows[10][1], "", ""), (10, rows[11][1], "", "")]
    random.Random(1).shuffle(rows)
    df = ready(spark).createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in M.top_k(df, df.where("vec_id % 10 = 0"), k=5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, lambda i: i % 10 == 0, 5)


def test_few_rows_and_none(spark):
    df = ready(spark).createDataFrame([(0, [1.0, 0.0], "", ""), (1, [0.5, 0.5], "", "")], SCHEMA)
    assert [tuple(r) for r in M.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 32768)]
    assert M.top_k(df.limit(0), df.limit(0)).collect() == []
    assert M.top_k(df, df.limit(0)).collect() == []


def exact(rows, queries, k, width):
    """By integers of any length; scores clamped to a long's range."""
    whole = [(i, [int(np.floor(np.float64(256) * np.float64(x))) for x in v] + [0] * (width - len(v))) for i, v, *_ in rows]
    out = []
    for n, (i, v) in enumerate(whole):
        if queries(i):
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for m, (j, w) in enumerate(whole) if m != n)[:k]
            out += [(i, r, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_large_components_and_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(M, "PAGE", 32)
    monkeypatch.setattr(M, "LEAF", 8)
    monkeypatch.setattr(M, "PIVOTS", 8)
    monkeypatch.setattr(M, "PAGES_AT_ONCE", 2)
    rng = np.random.default_rng(5)
    schema = "vec_id long, embedding array<double>, score string, vec string"
    for size, width in ((1.0, 1024), (1e5, 6), (1e8, 6), (1e30, 6), (1e300, 4)):
        rows = [(i, [float(x) for x in size * rng.normal(size=width)], "", "") for i in range(160)]
        rows += [(500 + i, [float(x) for x in rng.normal(size=width)], "", "") for i in range(40)]
        rows += [(600, rows[7][1], "", ""), (610, [x * (1 + 2**-52) for x in rows[7][1]], "", "")]
        df = ready(spark).createDataFrame(rows, schema)
        got = sorted(tuple(r) for r in M.top_k(df, df.where("vec_id % 10 = 0"), k=4).select("query_id", "rank", "vec_id", "score").collect())
        assert got == exact(rows, lambda i: i % 10 == 0, 4, width)


def test_keys_sort_as_numbers():
    numbers = [0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63), 10**300, -(10**300), 65535, 65536]
    assert sorted(numbers) == sorted(numbers, key=M.order_key)
