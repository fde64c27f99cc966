"""Unit vectors and exact cosine top-k."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its norm; a zero vector stays."""
    length = F.transform(F.array(norm(v)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n))[0]
    return F.transform(F.array(length), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


#: Doubles of a cell's matrix at most (8 MB), of a matrix of scores, and of the rows that are brought to unit length at once; rows of a cell at most.
CELL_VALUES, SCORE_VALUES, UNIT_VALUES, CELL_ROWS = 1 << 20, 1 << 19, 1 << 16, 1 << 16


def cosine_top_k(queries: DataFrame, corpus: DataFrame, k: int = 8, scope: str | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows of corpus (id, vector) to each of queries (query_id, query_vector), ties by id.

    With a scope column in both, only rows of the query's scope take part; a null
    scope is no one's. Both tables are dealt to a grid: a scope's queries in some
    rows of cells, its corpus in some columns, by hashes of their ids. A cell is a
    task's matrix product, and k rows a query leave it. So one hot scope is as many
    cells as it needs, and no table, count or query passes the driver.

    Null ids and null vectors, and vectors that hold null, NaN or infinite
    components, take no part on either side. Vectors of unlike length are compared as
    if zeros followed. Zero queries have no result, zero rows score 0. Rows that
    repeat an id are ranked each; queries that repeat one share their ranks.
    """
    where = F.col(scope) if scope else F.lit(0)
    q = _dealt(_usable(queries, "query_id", "query_vector", where).where(F.exists("vector", lambda x: x != 0)), "row")
    c = _dealt(_usable(corpus, "id", "vector", where), "column")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    sizes = q.sizes.join(c.sizes, "scope")
    asked = q.rows.join(sizes, "scope").select("scope", q.place("n_row").alias("row"), each(F.col("n_column")).alias("column"), F.col("key").alias("query_id"), F.lit(None).cast(c.kind).alias("id"), "vector")
    held = c.rows.join(sizes, "scope").select("scope", each(F.col("n_row")).alias("row"), c.place("n_column").alias("column"), F.lit(None).cast(q.kind).alias("query_id"), F.col("key").alias("id"), "vector")
    cells = asked.unionByName(held).groupBy("scope", "row", "column")
    found = cells.applyInArrow(lambda table: _cell(table, k), f"query_id {q.kind}, id {c.kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _usable(df: DataFrame, key: str, vector: str, scope: Column) -> DataFrame:
    """scope, key, vector (doubles) of rows that take part."""
    rows = df.select(scope.alias("scope"), F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("scope").isNotNull() & F.col("key").isNotNull() & F.coalesce(fine, F.lit(False)))


class _dealt:
    """A side of the grid: its rows, their key's type, and the number of cells of each scope, which its widest vector and its rows give."""

    def __init__(self, rows: DataFrame, side: str):
        self.rows, self.kind = rows, dict(rows.dtypes)["key"]
        most = F.least(F.lit(CELL_ROWS), F.greatest(F.lit(1), F.floor(F.lit(CELL_VALUES) / F.greatest(F.lit(1), F.max(F.size("vector"))))))
        self.sizes = rows.groupBy("scope").agg(F.ceil(F.count("*") / most).cast("int").alias(f"n_{side}"))

    def place(self, n: str) -> Column:
        return F.pmod(F.xxhash64("key", "vector"), F.col(n)).cast("int")


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors of at most `width` components, zeros following."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _unit_rows(m: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rows in the order given over their norms, taken without overflow; zero rows stay. Only the result is as large as m."""
    out = np.empty((len(order), m.shape[1]))
    step = max(1, UNIT_VALUES // max(1, m.shape[1]))
    for lo in range(0, len(order), step):
        part = m[order[lo : lo + step]]
        part = part / np.where((most := np.abs(part).max(axis=1, initial=0.0)) == 0, 1, most)[:, None]
        n = np.sqrt((part * part).sum(axis=1))
        out[lo : lo + step] = part / np.where(n == 0, 1, n)[:, None]
    return out


def _cell(table: pa.Table, k: int) -> pa.Table:
    """query_id, id, score: the k best rows of a cell for each of its queries."""
    asks = pc.is_valid(table["query_id"])
    asked, held = table.filter(asks).combine_chunks(), table.filter(pc.invert(asks)).combine_chunks()
    sides = [(x.column("vector").combine_chunks() if x.num_rows else pa.array([], pa.list_(pa.float64()))) for x in (asked, held)]
    sides = [x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in sides]
    width = max((pc.max(pc.list_value_length(x)).as_py() or 0 for x in sides), default=0)
    order = pc.sort_indices(held["id"]).to_numpy()  # positions then stand for ids on ties
    q, c = (_unit_rows(_matrix(x, width), o) for x, o in zip(sides, (np.arange(len(asked)), order), strict=True))
    rows, columns, scores = [], [], []
    step = max(1, SCORE_VALUES // max(1, len(c)))
    for lo in range(0, len(q) if len(c) else 0, step):
        block = q[lo : lo + step] @ c.T
        least = np.partition(block, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(block), -np.inf)
        row, column = np.nonzero(block >= least[:, None] - 1e-9)  # equal vectors may differ by rounding there
        score = np.einsum("ij,ij->i", q[lo + row], c[column])
        best = np.lexsort((column, -score, row))
        row, column, score = row[best], column[best], score[best]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        rows.append(lo + row[kept])
        columns.append(column[kept])
        scores.append(score[kept])
    row, column, score = (np.concatenate([np.zeros(0, dtype=t), *x]) for x, t in ((rows, np.int64), (columns, np.int64), (scores, np.float64)))
    return pa.table({"query_id": asked["query_id"].take(pa.array(row)), "id": held["id"].take(pa.array(order[column])), "score": score})


def hashing_embedder(size: int = 64):
    """A stand-in model: signed hashed words, unit length. Takes and returns a batch, as a client of a real one would."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), size), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = zlib.crc32(word.encode())
                out[row, h % size] += 1 if h >> 16 & 1 else -1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(lengths == 0, 1, lengths)).tolist()

    return embed


def embedded(rows: DataFrame, key: str, text: str, embed, batch: int = 50, retries: int = 1, wait: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, vector, and the columns to keep): texts in batches of 50 through a model, a batch tried once more, after `wait` seconds, if it fails.

    Arrow's batches stay as they are: only a model's batch is Python strings.
    """
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # what Arrow's batches leave over, so that the model's batches are full

        def ask(part: pa.Table) -> pa.RecordBatch:
            for attempt in range(retries + 1):
                try:
                    found = pa.array([None if v is None else list(v) for v in embed(part[text].to_pylist())], pa.list_(pa.float32()))
                    if len(found) != part.num_rows:
                        raise ValueError(f"{len(found)} vectors of {part.num_rows} texts")
                    return part.select(names).append_column("vector", found).combine_chunks().to_batches()[0]
                except Exception:
                    if attempt == retries:
                        raise
                    time.sleep(wait)
            raise AssertionError

        for rows in batches:
            held = pa.Table.from_batches([*(held.to_batches() if held else []), rows])
            while held.num_rows >= batch:
                yield ask(held.slice(0, batch))
                held = held.slice(batch)
        if held:
            yield ask(held)

    kinds = dict(rows.dtypes)
    return rows.select(*names, text).mapInArrow(run, ", ".join([f"{n} {kinds[n]}" for n in names]) + ", vector array<float>").select(key, "vector", *keep)


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no vector yet."""
    return rows.join(done.select(key), key, "left_anti")


def upsert(done: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old vectors and those of new keys; old ones stay."""
    return done.unionByName(pending(new, done, key))
