"""Keywords in texts, for tables of keywords too large for one CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Keyword
from ..functions.text import match_form

#: Letters of a piece; keywords that are shorter are their own piece.
PIECE = 3


def keyword_table(spark: SparkSession, keywords: tuple[Keyword, ...]) -> DataFrame:
    """(rank, form, matched_category, secondary_category, matched_keyword): the first in rank wins. Keywords are taken in their order, as keywords_from() gives it."""
    rows = [(n, k.form, k.primary, k.secondary, k.keyword) for n, k in enumerate(keywords)]
    return spark.createDataFrame(rows, "rank long, form string, matched_category string, secondary_category string, matched_keyword string")


def pieces(text: Column, size: int) -> Column:
    """The distinct runs of `size` letters of a text. One pattern that looks ahead finds them all, in time in proportion to the text.

    It also looks from inside letters of two UTF-16 units: such a run is none of a
    keyword's, but for the same keyword's in the same way, and what it leads to is held against the text.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def keyed(keywords: DataFrame) -> DataFrame:
    """keywords with piece: of the runs of PIECE letters of a form the one that fewest forms hold; a shorter form is its own. Empty forms are in every text and have none."""
    short = F.length("form") < PIECE
    each = keywords.select("rank", F.explode(F.when(short, F.array("form")).otherwise(pieces(F.col("form"), PIECE))).alias("piece"))
    n = each.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = each.join(n, "piece").groupBy("rank").agg(F.min(F.struct("n", "piece")).alias("least")).select("rank", "least.piece")
    return keywords.where("form <> ''").join(rarest, "rank")


def keyword_matches(texts: DataFrame, keywords: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, matched_category, secondary_category, matched_keyword) of the first keyword in title or text of each of texts (key, title, text); nulls if none.

    As Rules.category, by joins: a text's distinct pieces meet the keywords that have
    such a piece as their rarest, and only these are looked for in the text. key tells
    texts apart. Null titles and texts hold no keyword.
    """
    seen = texts.select(key, match_form(F.concat(F.col("title"), F.lit("\n"), F.col("text"))).alias("seen"))
    index = keyed(keywords)
    lengths = [n for (n,) in index.select(F.length("piece")).distinct().collect()]  # PIECE, and less where keywords are shorter
    own = F.concat(F.array().cast("array<string>"), *[pieces(F.col("seen"), n) for n in sorted(lengths)])
    found = seen.where("seen is not null").select(key, F.explode(own).alias("piece")).join(index.select("piece", "rank", "form"), "piece").select(key, "rank", "form")
    first = found.join(seen, key).where(F.contains("seen", "form")).groupBy(key).agg(F.min("rank").alias("rank"))
    everywhere = F.lit(keywords.where("form = ''").agg(F.min("rank")).first()[0]).cast("long")
    ranked = seen.join(first, key, "left").withColumn("rank", F.when(F.col("seen").isNotNull(), F.least("rank", everywhere)))
    return ranked.select(key, "rank").join(keywords, "rank", "left").select(key, "matched_category", "secondary_category", "matched_keyword")
