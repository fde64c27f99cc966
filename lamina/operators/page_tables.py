"""Tables of rendered pages: models find their boxes, Spark makes grids and texts.

Rendering and the two models are functions of the caller. A page's image stays in its
task: it is rendered, detected and recognised there, and only boxes and words leave.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any, BinaryIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.page_files import DPI, Opener, of_pages, opened
from . import boxes

SIDES = ("xmin", "ymin", "xmax", "ymax")
BOX = ", ".join(f"{s}: double" for s in SIDES)
FOUND = (
    "doc_id string, page int, seconds double, error string, "
    f"tables array<struct<score: double, {BOX}, left: double, top: double, width: double, height: double, objects: array<struct<label: string, score: double, {BOX}>>>>, "
    "words array<struct<word_no: int, x0: double, y0: double, x1: double, y1: double, text: string>>"
)

#: An image with its size; a model's objects (label, score, xmin, ymin, xmax, ymax).
Objects = list[dict[str, Any]]


def found_tables(
    ranges: DataFrame,
    render: Callable[[BinaryIO, int, int], tuple[int, int, Any]],
    detect: Callable[[Any], Objects],
    recognise: Callable[[Any, tuple[float, float, float, float]], Objects],
    words: Callable[[BinaryIO, int], list[dict]],
    dpi: int = DPI,
    opener: Opener = opened,
) -> DataFrame:
    """FOUND: a row for each page of ranges, with its tables and words, or its error.

    detect takes the image; recognise the image and a crop, a table's box with a margin inside the
    image, and gives rows and columns from the crop's corner, in pixels. words gives x0, y0, x1, y1,
    text in points. This is the costly part: store it, as candidates of it are read from it several times.
    """

    def each(file: BinaryIO, page: int) -> list[dict]:
        began = time.perf_counter()
        width, height, image = render(file, page, dpi)
        tables = []
        for t in detect(image):
            if t["label"] in boxes.TABLE_LABELS and t["score"] > boxes.DETECTED:
                left, top = (max(0.0, t[s] - boxes.PADDING) for s in ("xmin", "ymin"))
                right, low = min(float(width), t["xmax"] + boxes.PADDING), min(float(height), t["ymax"] + boxes.PADDING)
                crop = {"left": left, "top": top, "width": float(round(right) - round(left)), "height": float(round(low) - round(top))}
                tables.append({**{k: t[k] for k in ("score", *SIDES)}, **crop, "objects": recognise(image, (left, top, right, low))})
        placed = [{**w, "word_no": i} for i, w in enumerate(words(file, page))] if tables else []
        return [{"tables": tables, "words": placed, "seconds": time.perf_counter() - began}]

    return of_pages(ranges, each, FOUND, opener)


def page_candidates(found: DataFrame, dpi: int = DPI) -> DataFrame:
    """(doc_id, page, candidates, detected_tables, elapsed_sec, error) of found_tables(), its pages distinct.

    candidates: array<struct<rows, table_score, table_box, detected_rows, detected_cols>>, in the order of detection. Pages
    without tables and failed ones have none. A table without columns has as many empty rows as it has rows.
    """
    name = F.format_string("%s#%d#%d", F.col("doc_id"), F.col("page"), F.col("table_no")).alias("table_id")
    tables = found.select("doc_id", "page", "words", F.posexplode("tables").alias("table_no", "t")).select(name, "*").select("table_id", "doc_id", "page", "table_no", "words", "t.*")
    objects = tables.select("table_id", F.posexplode("objects").alias("object_id", "o")).select("table_id", "object_id", "o.*")
    kind = lambda label: boxes.detected(objects, (label,), boxes.STRUCTURED)
    edges = tables.select("table_id", F.lit(0.0).alias("t_xmin"), F.lit(0.0).alias("t_ymin"), F.col("width").alias("t_xmax"), F.col("height").alias("t_ymax"))
    rows, columns = boxes.grid_sides(kind(boxes.ROW_LABEL), kind(boxes.COLUMN_LABEL), edges)

    def in_points(side: DataFrame, axis: str, corner: str) -> DataFrame:
        moved: dict[str, Column] = {c: boxes.to_points(F.col(c), F.col(corner), dpi / 72) for c in (f"{axis}min", f"{axis}max")}
        return side.join(tables.select("table_id", corner), "table_id").withColumns(moved).drop(corner)

    words = tables.select("table_id", F.explode("words").alias("w")).select("table_id", "w.*")
    cells = boxes.grid_texts(in_points(rows, "y", "top"), in_points(columns, "x", "left"), words)
    texts = boxes.candidates(cells)
    n_rows = rows.groupBy("table_id").agg(F.count("*").cast("int").alias("n_rows"))
    none = F.array().cast("array<string>")
    n = F.coalesce("detected_rows", "n_rows", F.lit(0))
    one = F.struct(
        "table_no", F.coalesce("rows", F.array_repeat(none, n)).alias("rows"), F.col("score").alias("table_score"),
        F.array(*SIDES).alias("table_box"), n.alias("detected_rows"), F.coalesce("detected_cols", F.lit(0)).alias("detected_cols"),
    )
    each = tables.join(texts, "table_id", "left").join(n_rows, "table_id", "left").select("doc_id", "page", one.alias("c"))
    by_page = each.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.dropFields("table_no")).alias("candidates"))
    out = found.select("doc_id", "page", F.col("seconds").alias("elapsed_sec"), "error").join(by_page, ["doc_id", "page"], "left")
    given = F.when(F.col("candidates").isNotNull(), F.col("candidates")).otherwise(F.array())
    return out.select("doc_id", "page", given.alias("candidates"), F.size(given).alias("detected_tables"), "elapsed_sec", "error")


def extract_tables(ranges: DataFrame, path: str, render, detect, recognise, words, dpi: int = DPI, opener: Opener = opened) -> DataFrame:
    """page_candidates() of ranges; what the models found is stored at path first, so that a lost executor or a second reading runs no model again."""
    found_tables(ranges, render, detect, recognise, words, dpi, opener).write.mode("overwrite").parquet(path)
    return page_candidates(ranges.sparkSession.read.parquet(path), dpi)
