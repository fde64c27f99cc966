"""Document fingerprints: weighted SimHash and Hamming search in permuted block tables (DataFrame operations only).

Terms are the pairs of neighbouring words (a text of one word: the word), in
lower case. A term votes with its weight, 1 to 8 by its length, so that pairs of
short and frequent words say less: plus where a bit of its xxhash64 is set,
minus where not. A fingerprint bit is set where the sum is positive.

The 64 sums are kept two to a long, 32 bits apart, in 32 aggregates that
combine before the shuffle. Terms of one text are summed wherever they lie, so
a very long text is no more to one task than its own text.

Search: 64 bits are cut in five blocks. Within a radius of 3 at least two blocks
of two fingerprints agree, so each of the ten pairs of blocks, moved to the
front, is the key of one table, and the tables together find all fingerprints
within the radius. A pair that several tables find is taken from the first. The
base holds each fingerprint once, with its number of documents.

Defined cases: null text: empty; a text without words has fingerprint zero.
Repeated rows are rows of their own; the next document of a row is the next row
by doc_id, then text (where thousands share a doc_id, by their texts' hashes
first). Null doc_id comes first. A single row is its own next.
Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Buckets, constants, saved, whole_text

#: Widths of the five blocks, from the lowest bit.
BLOCKS = (13, 13, 13, 13, 12)
#: Rows of a bucket of neighbouring documents, about.
BUCKET_ROWS = 1500


def words_of(text: Column) -> Column:
    """Words in order, lower-cased."""
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


def terms_of(words: Column) -> Column:
    """Neighbouring words in pairs; the word itself if there is but one."""
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.lit(1), F.size(words) - 1)),
        F.slice(words, 2, F.greatest(F.lit(1), F.size(words) - 1)),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return pairs


def weight_of(term: Column) -> Column:
    return F.lit(1).cast("long") + F.floor(F.least(F.length(term), F.lit(28)) / 4)


def simhash(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """key columns (which tell rows apart), fp (long) for each row."""
    term = F.explode_outer(terms_of(words_of(F.col(text)))).alias("term")
    votes = texts.select(*key, term).select(
        *key, F.xxhash64("term").alias("h"), F.when(F.col("term").isNotNull(), weight_of(F.col("term"))).otherwise(0).alias("w")
    )
    two_bits = 0x0000000100000001
    sums = [
        F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(two_bits)) * F.col("w")).alias(f"s{i}") for i in range(32)
    ]
    summed = votes.groupBy(*key).agg(*sums, F.sum("w").alias("all"))
    fp: Column = F.lit(0).cast("long")
    for i in range(32):
        low = F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"s{i}", 32)
        for bit, votes_for in ((i, low), (i + 32, high)):
            fp = fp.bitwiseOR(F.when(2 * votes_for > F.col("all"), F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return summed.select(*key, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def block_tables(fp: Column, radius: int = 3) -> list[tuple[int, Column]]:
    """(table, key) of each permuted table: the blocks that agree when `radius` blocks don't."""
    at, parts = 0, []
    for width in BLOCKS:
        parts.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    tables = list(combinations(range(len(BLOCKS)), len(BLOCKS) - radius))
    return [(n, sum((parts[b] * (1 << (14 * i)) for i, b in enumerate(blocks)), F.lit(n).cast("long") * (1 << 56))) for n, blocks in enumerate(tables)]


def within_radius(base: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """(query, fp) for all distinct fingerprints fp of base within the radius of each fingerprint of queries."""
    tables = lambda c: F.explode(F.array(*[k for _, k in block_tables(F.col(c), radius)])).alias("key")
    asked = queries.select(F.col("fp").alias("query")).distinct().select("query", tables("query"))
    held = base.select("fp").distinct().select("fp", tables("fp"))
    agree = F.array(*[a == b for (_, a), (_, b) in zip(block_tables(F.col("query"), radius), block_tables(F.col("fp"), radius), strict=True)])
    first = F.array_position(agree, F.lit(True)) - 1 == F.shiftrightunsigned("l.key", 56)
    found = asked.alias("l").join(
        held.alias("r"),
        (F.col("l.key") == F.col("r.key")) & (F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= radius) & first,
    )
    return found.select("query", "fp")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, bucket, n (together they tell rows apart), text, next_text, extra, in ascending order of doc_id.

    Documents lie in buckets by range; the first rows of the bucket that follows
    are added at a bucket's end as extra rows, so nothing is ordered in one task.
    """
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    buckets = Buckets(docs.select(k.alias("k")), BUCKET_ROWS)
    keyed = docs.select(F.col("doc_id"), k.alias("k"), whole_text().alias("text")).withColumn("b", buckets.of(F.col("k"), F.xxhash64("text")).cast("int"))
    firsts = sorted(map(tuple, keyed.groupBy("b").agg(F.min("k")).collect()))  # a row for each bucket
    first_of, before = [0] * buckets.count, [0] * buckets.count
    for i, (b, first) in enumerate(firsts):
        first_of[b], before[b] = first, firsts[i - 1][0]  # the first follows the last
    own = F.struct("b", F.lit(False).alias("extra"))
    previous = F.get(constants(before), F.col("b")).cast("int")
    also = F.struct(previous.alias("b"), F.lit(True).alias("extra"))
    is_first = F.col("k") == F.get(constants(first_of), F.col("b"))
    placed = keyed.withColumn("place", F.explode(F.when(is_first, F.array(own, also)).otherwise(F.array(own))))
    order = Window.partitionBy("place.b").orderBy("place.extra", "k", "text")
    return placed.select(
        "doc_id", F.col("place.b").alias("bucket"), F.row_number().over(order).alias("n"), "text",
        F.lead("text").over(order).alias("next_text"), F.col("place.extra").alias("extra"),
    )


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the text that follows."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_report(docs: DataFrame, asks: Column, radius: int = 3) -> DataFrame:
    """A row per document with its fingerprint and its edited text's; n_near for rows where asks holds: documents within the radius, itself excluded."""
    rows = with_next(docs)
    key = ["bucket", "n"]
    facts = rows.select(
        *key, "doc_id", "extra", F.length("text").cast("long").alias("n_chars"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("text").alias("text")),
                F.struct(F.lit(1).alias("side"), edited(F.col("text"), F.coalesce("next_text", F.lit(""))).alias("text")),
            )
        ).alias("version"),
    ).where("version.side = 0 or not extra")
    whole = [*key, "doc_id", "extra", "n_chars", "side", "sha"]
    versions = facts.select(
        *key, "doc_id", "extra", "n_chars", "version.side", F.col("version.text").alias("text"),
        F.when(F.col("version.side") == 1, F.sha2(F.encode(F.col("version.text"), "UTF-8"), 256)).alias("sha"),
    )
    prints = simhash(versions, whole, "text")
    one = prints.groupBy(*key, "doc_id", "extra", "n_chars").agg(
        F.max("sha").alias("edited_sha256"),
        F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp"),
    )
    following = F.lead("fp").over(Window.partitionBy("bucket").orderBy("n"))
    one = saved(one.withColumn("next_fp", following).where("not extra"), "fingerprints")
    copies = one.groupBy("fp").agg(F.count("*").alias("n_docs"))
    near = (
        within_radius(copies, one.where(asks), radius)
        .join(copies, "fp")
        .groupBy("query")
        .agg((F.sum("n_docs") - 1).alias("n_near"))
    )
    hex_of = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    joined = one.join(near, one["fp"] == near["query"], "left")
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", hex_of("fp").alias("fingerprint"), hex_of("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(asks, F.col("n_near")).alias("n_near"),
    )
