"""Positioned blocks to page texts.

blocks: doc_id, page, block_idx, x0, y0, x1, y1, text, block_type (0 is text),
page_w, page_h.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_lines, collapsed, is_page_number, sanitised, stripped

HEADER, FOOTER, REPEATED = 0.08, 0.92, 0.4
LABEL_WIDTH, LABEL_GAP, LEAST_CHARS, COLUMN_MARK = 0.45, 0.7, 2, " | "


def clean_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("text", sanitised(F.col("text")))


def repeated_texts(blocks: DataFrame, header: float = HEADER, footer: float = FOOTER, share: float = REPEATED) -> DataFrame:
    """(doc_id, norm): texts that occur in the header or in the footer zone as often as `share` of the document's pages.

    Counts are of occurrences, for each zone by itself; blocks of all types count.
    """
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"))
    zone = F.when(F.col("y1") < F.col("page_h") * header, "header").when(F.col("y0") > F.col("page_h") * footer, "footer")
    seen = (
        blocks.withColumn("zone", zone)
        .where(F.col("zone").isNotNull() & (F.length(stripped(F.col("text"))) >= LEAST_CHARS))
        .groupBy("doc_id", "zone", collapsed(F.col("text")).alias("norm"))
        .agg(F.count("*").alias("n"))
    )
    return seen.join(pages, "doc_id").where(F.col("n") >= share * F.col("n_pages")).select("doc_id", "norm").distinct()


def group_rows(blocks: DataFrame) -> DataFrame:
    """Adds row_no: by y0, a block starts a row if its centre lies below all blocks before it."""
    order = Window.partitionBy("doc_id", "page").orderBy("y0", "block_idx")
    reach = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce((reach < 0) | ((F.col("y0") + F.col("y1")) / 2 > reach), F.lit(True))
    return blocks.withColumn("__starts", starts.cast("int")).withColumn("row_no", F.sum("__starts").over(order).cast("long")).drop("__starts")


def without_noise(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Without short blocks, page numbers and repeated texts, wherever these are on a page."""
    kept = rows.withColumn("norm", collapsed(F.col("text"))).where((F.length(stripped(F.col("text"))) >= LEAST_CHARS) & ~is_page_number(F.col("text")))
    return kept.join(repeated, ["doc_id", "norm"], "left_anti").drop("norm")


def format_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, page, row_no, row_text): one block as it is, a label at the left before its text, else columns by x0."""
    packed = rows.groupBy("doc_id", "page", "row_no").agg(
        F.array_sort(F.collect_list(F.struct("x0", "y0", "block_idx", "x1", stripped(F.col("text")).alias("text")))).alias("b"), F.max("page_w").alias("w")
    )
    at = lambda i: F.get("b", F.lit(i))
    edge = F.col("w") * LABEL_WIDTH
    label = (F.size("b") == 2) & (at(0)["x1"] <= edge) & (at(1)["x0"] > edge * LABEL_GAP) & (at(0)["text"] != "") & (at(1)["text"] != "")
    columns = F.array_join(F.transform(F.filter("b", lambda x: x["text"] != ""), lambda x: collapsed(x["text"])), COLUMN_MARK)
    text = (
        F.when(F.size("b") == 1, at(0)["text"])
        .when(label, F.concat(collapsed(at(0)["text"]), F.lit("\n"), at(1)["text"]))
        .otherwise(columns)
    )
    return packed.select("doc_id", "page", "row_no", text.alias("row_text"))


def page_texts(blocks: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) from blocks."""
    clean = clean_blocks(blocks)
    rows = group_rows(clean.where("block_type = 0"))
    lines = format_rows(without_noise(rows, repeated_texts(clean))).withColumn(
        "row_text", F.array_join(F.transform(clean_lines(F.col("row_text")), collapsed), "\n")
    )
    texts = (
        lines.where("row_text <> ''")
        .groupBy("doc_id", "page")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("row_no", "row_text")))["row_text"], "\n").alias("text"))
    )
    pages = clean.select("doc_id", "page").distinct()
    return pages.join(texts, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))
