"""The permutation index against brute force: exact where shards are searched whole, recall where they are not."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from lamina.llm import permutation_index as P
from lamina.llm.common import ready
from oracle import SF

SCHEMA = "vec_id long, embedding array<float>, score string, vec string, shard int"


def brute(rows, queries, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for n, (i, v) in enumerate(good):
        if queries(i):
            best = sorted((-float((w * v).sum()), j) for m, (j, w) in enumerate(good) if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12, atol=1e-12)


def test_small_shards_are_exact(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 100)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8) * (1 + i % 3))], "a", "b", 0) for i in range(300)]
    rows += [(1000 + i, rows[3][1], "a", "b", 0) for i in range(120)]  # one vector many times
    rows += [(50, None, "", "", 0), (100, [1.0, None], "", "", 0), (150, [float("nan")] * 8, "", "", 0), (200, [float("inf")] * 8, "", "", 0), (250, [0.0] * 8, "", "", 0)]
    rows += [(2000, [1.0, 2.0], "", "", 0), (2050, [], "", "", 0), (None, [1.0] * 8, "", "", 0), (10, rows[10][1], "", "", 0), (10, rows[11][1], "", "", 0)]
    random.Random(1).shuffle(rows)
    df = ready(spark).createDataFrame(rows, SCHEMA)
    same(rows_of(P.nearest(df, df.where("vec_id % 10 = 0"), k=7)), brute(rows, lambda i: i % 10 == 0, 7))


def test_few_rows_none_and_huge_components(spark):
    df = ready(spark).createDataFrame([(0, [1.0, 0.0], "", "", 0), (1, [0.5, 0.5], "", "", 0)], SCHEMA)
    assert rows_of(P.nearest(df, df.where("vec_id = 0"))) == [(0, 1, 1, 0.5)]
    assert P.nearest(df.limit(0), df.limit(0)).collect() == []
    assert P.nearest(df, df.limit(0)).collect() == []
    huge = ready(spark).createDataFrame([(0, [1e300, 1e300]), (1, [1e300, -1e300]), (2, [1e300, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r[2] for r in rows_of(P.nearest(huge, huge.where("vec_id = 0")))] == [2, 3, 1]


def test_footrule_is_that_of_the_orders():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(50, 6))
    pivots = P.Pivots(vectors[:20], 1.0, float((vectors**2).sum(axis=1).max()))
    pivots.prefix, pivots.opened = 8, 5
    shard = P.unpacked(P.build_shard(vectors, [np.array([i]) for i in range(50)], pivots))
    orders, opened = pivots.order(pivots.lifted(vectors), 8).tolist(), pivots.of_queries(vectors[:3])
    for q in range(3):
        want = [sum(abs((o.index(p) if p in o else 8) - at) for at, p in enumerate(opened[q].tolist())) for o in orders]
        assert P.footrule(shard, opened[q], 8).tolist() == want


@pytest.mark.parametrize("structure", ["none", "groups", "norms", "table"])
def test_recall(structure):
    """Of one large shard, as the index's other shards are."""
    rng = np.random.default_rng(4)
    if structure == "table":
        vectors = np.array(pq.read_table(f"{SF}/embeddings.parquet")["embedding"].to_pylist(), dtype=float)
        vectors = np.vstack([vectors, rng.permuted(vectors, axis=0), rng.permuted(vectors, axis=0), rng.permuted(vectors, axis=0)])
    else:
        vectors = rng.normal(size=(4000, 64))
        if structure == "groups":
            vectors = rng.normal(size=(40, 64))[rng.integers(0, 40, 4000)] + 0.4 * vectors
        if structure == "norms":
            vectors *= rng.uniform(0.2, 3, size=4000)[:, None]
    pivots = P.Pivots(vectors[rng.permutation(len(vectors))[: P.PIVOTS]], 2.0**-8, float((vectors**2).sum(axis=1).max()) * 2.0**-16)
    shard = P.unpacked(P.build_shard(vectors, [np.array([i]) for i in range(len(vectors))], pivots))
    asked = np.arange(0, len(vectors), 40)
    found = P.search_shard(shard, vectors[asked], asked, pivots.of_queries(vectors[asked]), pivots.prefix, 20)
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    recall = np.mean([len({i for r, i, _ in found if r == n} & set(best[n].tolist())) / 20 for n in range(len(asked))])
    print(structure, round(recall, 4))
    assert recall >= 0.9
