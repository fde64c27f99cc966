"""Mixing sources to target weights along a time-varying curriculum (DataFrame operations only).

Each source has a weight and a schedule, a line over training time t in [0, 1].
The integral of the schedule up to t is the share of the source's target that is
due by then; its inverse gives the position of a word from the number of the
source's words before it. Documents of a source lie in a fixed pseudo-random
order, repeated for each epoch, and the mix takes the first `target` words.

Running sums are taken in buckets of about BUCKET_ROWS rows with offsets from
bucket totals, so a source that holds a third of all rows is still spread.

Defined cases: null or empty text: size 0, taken 0, no position. Null source: a
source of its own, last. Rows that repeat (doc_id, source, size) share what the
mix takes of them equally, to a word: the first ones take one more. Empty table:
empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, n_words, saved, whole_text

#: Rows of a bucket, about.
BUCKET_ROWS = 4000
#: Change of a source's schedule over training by weight: its line runs from 1 - s to 1 + s.
SLOPES = {1: -0.5, 2: 0.0, 3: 0.5}


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(whole_text()).alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """A row per source: sid, source, source_size, weight, target (weights by rank in code point order, null last).

    A target is least(epochs * source_size, weight * level), with the one level
    that makes targets add up to all sizes: what repeated resharing of the
    excess by weight ends in. With sources in order of cap / weight, the level
    that follows from capping the first k is highest at the right k. The table
    is as long as the list of sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0))
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    weighed = (
        per_source.withColumn("sid", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    level = (F.sum("source_size").over(everything) - before("cap")) / (F.sum("weight").over(everything) - before("weight"))
    return (
        weighed.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select("sid", "source", "source_size", "n_rows", "weight", "target")
    )


def due_at(share: Column, slope: Column) -> Column:
    """Inverse of the integral (1 - s) t + s t**2 of a schedule."""
    b = 1 - slope
    root = (F.sqrt(b * b + 4 * slope * share) - b) / (2 * slope)
    return F.when(F.abs(slope) < 1e-9, share).otherwise(root)


def place_of(doc_id: Column, size: Column) -> Column:
    """52 pseudo-random bits that order a source's documents, which SQL can say too; buckets are ranges of them."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), size.cast("string"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    epochs: int = 3,
    slopes: dict[int, float] | None = None,
) -> DataFrame:
    """A row per (doc_id, source, size): n_same rows share it; passes holds each epoch's (words, more, position): each of them takes `words`, the first `more` ones another."""
    sizes = saved(sized(docs), "sizes")
    sources = saved(targets(sizes, weights, epochs), "sources")
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_same"))
    placed = (
        units.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
        .drop("name")
        .withColumn("place", place_of(F.col("doc_id"), F.col("size")))
        .withColumn("bucket", F.shiftright(F.shiftright("place", 22) * F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_rows") / BUCKET_ROWS)), 30))
        .withColumn("words", F.col("size") * F.col("n_same"))
    )
    in_source = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    in_bucket = Window.partitionBy("sid", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("sid", "bucket")
        .agg(F.sum("words").alias("in_bucket"))
        .select("sid", "bucket", F.coalesce(F.sum("in_bucket").over(in_source), F.lit(0)).alias("offset"))
    )
    slope = F.element_at(
        F.create_map(*[F.lit(x) for kv in (slopes or SLOPES).items() for x in kv]), F.col("weight")
    )
    demand = F.round("target").cast("long")
    started = (
        placed.join(saved(offsets, "offsets"), ["sid", "bucket"])
        .withColumn("start", F.col("offset") + F.coalesce(F.sum("words").over(in_bucket), F.lit(0)))
        .withColumn("demand", demand)
    )
    taken = lambda e: F.greatest(F.lit(0), F.least(F.col("words"), F.col("demand") - F.col("start") - F.col("source_size") * e))
    one_pass = lambda e: F.struct(
        F.floor(taken(e) / F.col("n_same")).alias("words"),
        (taken(e) % F.col("n_same")).alias("more"),
        due_at(
            F.least(F.lit(1.0), (F.col("start") + F.col("source_size") * e) / F.greatest(F.lit(1), F.col("demand"))), slope
        ).alias("position"),
    )
    passes = F.filter(F.array(*[one_pass(e) for e in range(epochs)]), lambda p: p["words"] + p["more"] > 0)
    return started.select("doc_id", "source", "size", "n_same", "source_size", "target", passes.alias("passes"))


def passes_of(copy: Column) -> Column:
    """The passes over one of the rows that share a size, by its number from 0: array<struct<words, position>>."""
    words = lambda p: p["words"] + F.when(copy < p["more"], F.lit(1)).otherwise(F.lit(0))
    all_passes = F.transform("passes", lambda p: F.struct(words(p).alias("words"), p["position"].alias("position")))
    return F.filter(all_passes, lambda p: p["words"] > 0)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """A row per row of docs, in training order: doc_id, size, source_size, target, taken, position (of the first pass; null if none)."""
    planned = mix(docs, **options)
    return (
        planned.select("*", F.posexplode(F.expr("array_repeat(0, int(n_same))")).alias("copy", "zero"))
        .withColumn("passes", passes_of(F.col("copy")))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            F.aggregate("passes", F.lit(0).cast("long"), lambda n, p: n + p["words"]).alias("taken"),
            F.array_min(F.transform("passes", lambda p: p["position"])).alias("position"),
        )
        .orderBy("position", "doc_id")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, a row per pass over a document, range-sorted by training position.

    A pass that takes part of a document holds its first words, joined by single spaces.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", n_words(whole_text()).alias("size"))
    planned = saved(mix(docs, **options), "mix").select(
        F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), "n_same", "passes"
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("p_id"))
        & F.col("source").eqNullSafe(F.col("p_source"))
        & (F.col("size") == F.col("p_size"))
    )
    first_words = F.array_join(
        F.slice(F.split(F.regexp_replace(F.col("doc.text"), "^" + SPACE, ""), SPACE), 1, F.col("pass.words").cast("int")), " "
    )
    text = F.when(F.col("pass.words") >= F.col("size"), F.col("doc.text")).otherwise(first_words)
    alike = Window.partitionBy("p_id", "p_source", "p_size").orderBy(F.xxhash64("doc.text"))
    single = keyed.join(planned.where("n_same = 1"), same).withColumn("copy", F.lit(0))
    several = keyed.join(planned.where("n_same > 1"), same).withColumn("copy", F.row_number().over(alike) - 1)
    rows = single.unionByName(several) if planned.where("n_same > 1").limit(1).count() else single
    passes = rows.withColumn("pass", F.explode(passes_of(F.col("copy"))))
    return passes.select(
        *[
            text.alias("text") if c == "text"
            else F.char_length(text).cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars"
            else F.col("doc")[c].alias(c)
            for c in docs.columns
        ],
        F.col("pass.position").alias("__position"),
    ).sort("__position", "doc_id").drop("__position")
