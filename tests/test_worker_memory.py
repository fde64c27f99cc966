"""A Python worker holds Arrow's batches as they are, and few rows of them as Python objects."""

import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
from lamina.operators import reports, vectors
from lamina.plans import relations as R


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def run_of(rows, **options):
    """What vectors.embedded gives Spark to run in a worker."""
    held = []
    rows.select = lambda *_: SimpleNamespace(**{name: lambda f, _: held.append(f) or SimpleNamespace(select=lambda *_: None) for name in ("mapInArrow", "mapInPandas")})
    vectors.embedded(rows, "id", "text", **options)
    return held[0]


def test_tables_come_in_small_batches(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/t.parquet")
    other = spark.newSession()
    R.table(other, str(tmp_path), "t")
    assert int(other.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_shares_of_a_batch_of_long_texts():
    cells = [f"cell {i}" for i in range(40)]
    batch = pa.array([cells] * 3000), pa.array(["no such text " * 8] * 3000)
    found = []
    assert peak_mb(lambda: found.extend(reports.shares_of(iter([batch])))) < 6  # 40 floats of 3,000 rows, and a table's automaton
    assert found[0].to_pylist()[7] == [reports.share(c, "no such text " * 8) for c in cells]


def test_embedding_a_batch_of_long_texts():
    run = run_of(SimpleNamespace(dtypes=[("id", "bigint"), ("text", "string")]), embed=lambda texts: [[float(len(t or ""))] for t in texts])
    texts = [None, *["x" * 20_000] * 998, "y"]
    rows = pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": texts})
    out = []
    assert peak_mb(lambda: out.extend(run(iter([rows.slice(0, 0), rows.slice(0, 70), rows.slice(70)])))) < 5  # 50 texts of 20 kB, of 20 MB
    assert [b.num_rows for b in out] == [50] * 20
    table = pa.Table.from_batches(out)
    assert table["id"].to_pylist() == list(range(1000)) and table["vector"].to_pylist() == [[float(len(t or ""))] for t in texts]
