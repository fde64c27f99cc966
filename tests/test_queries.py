"""Every query against its DuckDB statement, and the driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import pytest
from lamina.plans import registry
from oracle import SF, holds


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_duckdb(spark, name):
    holds(spark, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())


def test_imports_without_a_session_or_the_corpus_operators(tmp_path):
    root = Path(entry.__file__).parent
    for name in ("__spark_entry__.py", "lamina"):
        subprocess.run(["cp", "-r", str(root / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "lamina/llm")], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(registry.QUERIES)), "False"], said.stderr
