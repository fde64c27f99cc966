"""The grid search against brute force, with every kind of row that takes no part."""

import math
import random

import numpy as np
import pytest
from lamina.operators import vectors as V


def brute(queries, corpus, k, scoped):
    fine = lambda i, v: i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    width = max([len(v) for *_, v in queries + corpus if v is not None], default=0)
    unit = lambda v: (lambda a: a / (np.linalg.norm(a) or 1))(np.pad(np.array(v, dtype=float), (0, width - len(v))))
    out = []
    for q, qs, qv in queries:
        if not fine(q, qv) or not any(qv) or (scoped and qs is None):
            continue
        scored = [(-round(float(unit(qv) @ unit(v)), 9), i) for i, s, v in corpus if fine(i, v) and (not scoped or s == qs)]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def tables(seed=3):
    rng = random.Random(seed)
    vector = lambda n=6: [round(rng.gauss(0, 1), 3) for _ in range(n)]
    corpus = [(f"c{i:03}", rng.choice(["hot", "hot", "hot", "cold"]), vector()) for i in range(150)]
    same = vector()
    corpus += [(f"same{i:02}", "hot", same) for i in range(30)] + [("zero", "hot", [0.0] * 6), ("null", "hot", None), ("hole", "hot", [1.0, None]), ("nan", "hot", [math.nan] * 6), ("inf", "hot", [math.inf] * 6)]
    corpus += [("short", "hot", [1.0]), ("empty", "hot", []), ("long", "cold", vector(9)), ("nowhere", None, vector()), (None, "hot", vector())]
    queries = [(i, rng.choice(["hot", "cold", "unknown"]), vector()) for i in range(40)]
    queries += [(100, "hot", None), (101, "hot", [0.0] * 6), (102, "hot", [1.0, None]), (103, "hot", [math.nan]), (104, "cold", [2.0]), (105, "hot", vector(9)), (106, None, vector()), (None, "hot", vector()), (107, "hot", same), (108, "hot", [])]
    return queries, corpus


@pytest.mark.parametrize("scoped", [False, True])
@pytest.mark.parametrize("values", [1 << 22, 90])
def test_matches_brute_force(spark, monkeypatch, scoped, values):
    monkeypatch.setattr(V, "CELL_VALUES", values)
    monkeypatch.setattr(V, "SCORE_VALUES", values)
    queries, corpus = tables()
    q = spark.createDataFrame(queries, "query_id long, scope string, query_vector array<double>")
    c = spark.createDataFrame(corpus, "id string, scope string, vector array<double>")
    got = V.cosine_top_k(q, c, 7, "scope" if scoped else None).collect()
    want = brute(queries, corpus, 7, scoped)
    assert sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9) + 0.0) for r in got) == [(a, b, c, d + 0.0) for a, b, c, d in want]
    assert all(r["score"] is not None and math.isfinite(r["score"]) for r in got)


def test_large_components_and_empty_tables(spark):
    q = spark.createDataFrame([(1, [1e200, 1e200])], "query_id long, query_vector array<double>")
    c = spark.createDataFrame([(1, [3e200, 3e200]), (2, [1e-200, 0.0])], "id long, vector array<double>")
    assert [(r["id"], round(r["score"], 6)) for r in V.cosine_top_k(q, c).orderBy("rank").collect()] == [(1, 1.0), (2, 0.707107)]
    assert V.cosine_top_k(q, c.limit(0)).collect() == [] and V.cosine_top_k(q.limit(0), c).collect() == []


def test_the_plan_does_not_grow_with_queries_and_the_driver_sees_none(spark, monkeypatch):
    def plan(n):
        q = spark.range(n).selectExpr("id as query_id", "array(1d, cast(id as double)) as query_vector")
        c = spark.range(50).selectExpr("id", "array(cast(id as double), 1d) as vector")
        return V.cosine_top_k(q, c)._jdf.queryExecution().analyzed().toString().count("\n")

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", None)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.collect", None)
    assert plan(10) == plan(100_000)


def test_memory_of_a_full_cell():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    n = min(V.CELL_ROWS, V.CELL_VALUES // 64)
    flat = pa.array(rng.normal(size=(n + 100) * 64))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 101, dtype=np.int32) * 64), flat)
    table = pa.table({"query_id": pa.array([*range(100), *[None] * n]), "id": pa.array([*[None] * 100, *range(n)]), "vector": vectors})
    tracemalloc.start()
    found = V._cell(table, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 800
    assert peak < 40 << 20
