"""Groups of overlapping intervals where one key may hold more rows than a task should."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a key at most.
MOST = 1024


def _same(left: DataFrame, right: DataFrame, keys: list[str], nulls: bool = True) -> DataFrame:
    """left with the columns of right's row of the same keys, nulls included; null where there is none.

    Without nulls in keys, rows that are dealt by them already stay where they are: null-safe equality deals them anew.
    """
    if not nulls:
        return left.join(right, keys, "left")
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"__r_{k}"]) for k in keys])
    return left.join(other, on, "left").drop(*[f"__r_{k}" for k in keys])


def ranged(df: DataFrame, keys: list[str], at: str, rows: int) -> DataFrame:
    """Adds __range: ascending ranges of `at` with about `rows` rows each, up to MOST a key; keys of no more rows have one.

    The cuts are quantiles, which merge before their shuffle. Only keys with several ranges carry
    cuts, so their table is small, and Spark splits a hot key's rows or broadcasts. Rows of one key and place share a range.
    """
    shares = [i / MOST for i in range(1, MOST)]
    facts = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx(at, shares, 10 * MOST).alias("__all"))
    step = F.greatest(F.lit(1), F.floor(F.lit(MOST * rows) / F.col("__n")))
    cuts = F.array_distinct(F.filter("__all", lambda c, i: (i + 1) % step == 0)).alias("__cuts")
    hot = facts.where((F.col("__n") > rows) & F.col("__all").isNotNull()).select(*keys, cuts)
    place = F.when(F.col("__cuts").isNull() | F.col(at).isNull(), 0).otherwise(F.size(F.filter("__cuts", lambda c: c <= F.col(at))))
    return _same(df, hot, keys).withColumn("__range", place).drop("__cuts")


def carried(frame: DataFrame, keys: list[str], of: Column, how: Callable[[str], Column], name: str, nulls: bool = True) -> DataFrame:
    """frame, which has __range, with `how` (a sum or maximum) of an aggregate over all ranges of the keys before a row's own; null in the first."""
    one = [*keys, "__range"]
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return _same(frame, frame.groupBy(*one).agg(of.alias("__x")).select(*one, how("__x").over(earlier).alias(name)), one, nulls)


def running(frame: DataFrame, keys: list[str], at: list[str], value: str, most: bool = False, nulls: bool = True) -> DataFrame:
    """frame, which has __range, with its column `value` summed up (or its maximum so far) in order of at, over ranges as in one window. nulls: whether keys and __range may be null."""
    how = F.max if most else F.sum
    order = Window.partitionBy(*keys, "__range").orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    found = carried(frame, keys, how(value), how, "__before", nulls)
    here = how(value).over(order)
    return found.withColumn(value, F.greatest(here, "__before") if most else here + F.coalesce("__before", F.lit(0).cast("long"))).drop("__before")


def numbered_groups(df: DataFrame, keys: list[str], low: str, high: str, tie: str, rows: int) -> DataFrame:
    """Adds group_no: by (low, tie), an interval starts a group if it begins beyond the end of all before it, or has no beginning.

    Windows see one range of a key; the greatest end and the number of groups of the ranges before are carried into it.
    """
    order = Window.partitionBy(*keys, "__range").orderBy(low, tie)
    parts = carried(ranged(df, keys, low, rows), keys, F.max(high), F.max, "__before")
    reach = F.greatest(F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("__before"))
    starts = parts.withColumn("group_no", F.coalesce(F.col(low) > reach, F.lit(True)).cast("long")).drop("__before")
    return running(starts, keys, [low, tie], "group_no").drop("__range")
