"""What the corpus operators share: word rules, the shared folder, range buckets."""

from __future__ import annotations

import atexit
import itertools
import math
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import ready

#: ASCII white space of the word rule: a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one is made for a session in a single process; a cluster's must be set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not jdir.isDefined():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lamina-"))
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    return jdir.get().rstrip("/")


def saved(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lamina/{what}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written() -> int:
    """How many tables stand in the shared folder; released() takes the number."""
    return len(_written)


def released(since: int, keep: int = 1) -> None:
    """Deletes the tables written since, but for the last `keep` ones: for callers that are done with all that reads them."""
    done = _written[since : len(_written) - keep]
    del _written[since : len(_written) - keep]
    for spark, path in done:
        _delete(spark, path)


@atexit.register
def _sweep() -> None:
    """Tables written for the session go when it ends."""
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words (long)."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hash_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """About n rows by a hash of keys, the same ones at every run; all if there are no more than n. Nothing is sorted or gathered for it.

    keys should tell rows apart (an id and its text): rows that share them come together.
    """
    total = df.count()
    if total <= n:
        return df
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < math.ceil(n / total * (1 << 30)))


def constants(values: list[int]) -> Column:
    """An array<long> of many values as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def range_bounds(df: DataFrame, key: str, buckets: int, weight: str | None = None) -> list[int]:
    """About buckets - 1 ascending cut points of a long column without nulls, that part rows (or their weights) evenly: every eighth of the distinct keys that a hash picks."""
    if buckets < 2:
        return []
    heavy = F.col(weight) if weight else F.lit(1)
    step = max(1, df.agg(F.sum(heavy)).first()[0] // (8 * buckets))
    picked = df.where(F.pmod(F.xxhash64(key), F.lit(step)) < heavy).select(key).distinct()
    found = np.sort(np.array([r[0] for r in picked.collect()], dtype=np.int64))  # 8 * buckets
    return found[4::8].tolist()


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below key, by binary search in one constant array."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    cut = constants([*bounds, *[2**63 - 1] * (2**steps - len(bounds))])
    halves = F.array(*[F.lit(1 << step) for step in reversed(range(steps))])
    return F.aggregate(
        halves, F.lit(0), lambda at, half: F.when(key >= F.get(cut, at + half - 1), at + half).otherwise(at)
    )


#: Buckets of ordered rows at most: at 100 TB one holds 1.5 GB of text, a task's sort that spills.
MOST_BUCKETS = 1 << 16


class Buckets:
    """Ascending buckets of about `rows` rows over (key, tie): a long key without nulls, and a hash that parts rows of one key.

    A key of its own with many rows gets as many buckets as it needs, by the tie's highest 31 bits;
    other buckets are ranges of keys.
    """

    def __init__(self, keys: DataFrame, rows: int):
        """keys: a DataFrame of the key alone."""
        name = keys.columns[0]
        self.bounds = range_bounds(keys, name, min(MOST_BUCKETS, keys.count() // rows))
        sizes = keys.groupBy(range_bucket(F.col(name), self.bounds).alias("b")).count()
        self.count, self.base, self.slots = len(self.bounds) + 1, [], []
        if not sizes.where(F.col("count") > 32 * rows).limit(1).count():
            return
        hot = keys.groupBy(name).count().where(F.col("count") > 4 * rows).collect()  # a row for 4 * rows ones at least
        many = {r[0]: -(-r[1] // rows) for r in hot}
        self.bounds = sorted({*self.bounds, *many, *[k + 1 for k in many if k < 2**63 - 1]})
        self.slots = [1, *[many.get(k, 1) for k in self.bounds]]
        self.base = [0, *itertools.accumulate(self.slots)][:-1]
        self.count = sum(self.slots)

    def of(self, key: Column, tie: Column) -> Column:
        at = range_bucket(key, self.bounds)
        if not self.base:
            return at
        slot = F.shiftright(F.shiftrightunsigned(tie, 33) * F.get(constants(self.slots), at), 31)
        return (F.get(constants(self.base), at) + slot).cast("int")
