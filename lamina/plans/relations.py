"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_lines, stripped
from ..sources.session import ready

#: Lines of a document that make a page.
PAGE_LINES = 20

#: Before a line, how many of its characters, and after it: the wordings of policies that their rules tell apart.
POLICY_FORMS = (
    ("제 3 장  ", 40, ""), ("제12조(", 30, ")"), ("7. ", 100, ""), ("나. ", 20, ""), ("", 25, " 배상책임"), ("용어의 정의", 0, ""),
    ("보상하지 않는\t손해 ", 60, ""), ("목차 제1조(", 20, ")"), ("보험금의  청구 ", 200, ""), ("제 4 조 [", 78, "]"), ("여행중단 ", 600, " 면책사항"), ("", 60, ""),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines, twenty to a page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(clean_lines(F.col("text")))).alias("lines"))
    paged = docs.select(
        "doc_id",
        "lines",
        F.explode(F.sequence(F.lit(1), F.ceil(F.size("lines") / PAGE_LINES).cast("int"))).alias("page"),
    ).where(F.size("lines") > 0)
    return paged.select("doc_id", F.col("page").cast("long").alias("page"), F.array_join(F.slice("lines", (F.col("page") - 1) * PAGE_LINES + 1, PAGE_LINES), "\n").alias("text"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as positioned blocks: an order is a document, a group of seven lines a page."""
    n = F.col("l_linenumber").cast("long")
    across = F.pmod(F.col("l_partkey"), F.lit(3))
    x0 = F.lit(40.0) + across * F.lit(180.0)
    y0 = F.pmod(F.col("l_suppkey") * 37 + n * 13, F.lit(90)) * 9.0
    text = F.when(F.pmod(F.col("l_partkey"), F.lit(5)) == 0, F.lit("Terms  of\tservice")).when(F.pmod(F.col("l_partkey"), F.lit(7)) == 0, n.cast("string")).otherwise(
        F.concat(F.lit(" part\u0001 "), F.col("l_partkey").cast("string"), F.lit(" "), F.col("l_returnflag"), F.lit("\n"), F.col("l_linestatus"), F.lit(" "))
    )
    return table(spark, sf_dir, "lineitem").select(
        F.pmod(F.col("l_orderkey"), F.lit(2000)).alias("doc_id"), F.floor(F.col("l_orderkey") / 2000).alias("page"),
        ((F.col("l_orderkey") * 10 + n) * 1000000 + F.col("l_partkey")).alias("block_idx"), x0.alias("x0"), y0.alias("y0"),
        (x0 + F.pmod(F.col("l_partkey"), F.lit(170))).alias("x1"), (y0 + 5 + F.pmod(F.col("l_partkey"), F.lit(9))).alias("y1"), text.alias("text"),
        F.when(F.pmod(F.col("l_suppkey"), F.lit(11)) == 0, 1).otherwise(0).alias("block_type"), F.lit(595.0).alias("page_w"), F.lit(842.0).alias("page_h"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as detected boxes: an order is a table; even lines are rows, odd ones columns."""
    n = F.col("l_linenumber").cast("long")
    x, y = F.pmod(F.col("l_partkey") * 7, F.lit(500)) * 1.0, F.pmod(F.col("l_suppkey") * 13 + n * 61, F.lit(700)) * 1.0
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("table_id"), ((F.col("l_orderkey") * 10 + n) * 1000000 + F.col("l_partkey")).alias("object_id"),
        F.when(F.pmod(n, F.lit(2)) == 0, "table row").otherwise("table column").alias("label"), (1 - F.col("l_discount") * 6).alias("score"),
        x.alias("xmin"), y.alias("ymin"), (x + F.col("l_quantity") * 3).alias("xmax"), (y + F.col("l_quantity") * 2).alias("ymax"),
    )


def policy_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): lines in the forms of POLICY_FORMS, one after the other."""
    made = F.lit(None).cast("string")
    for i, (head, n, tail) in enumerate(POLICY_FORMS):
        made = F.when(F.pmod("line_no", F.lit(len(POLICY_FORMS))) == i, F.concat(F.lit(head), F.substring("line", 1, n), F.lit(tail))).otherwise(made)
    return lines.select("doc_id", "line_no", stripped(made).alias("line"))
