"""Detected boxes to table grids.

objects: table_id, object_id, label, score, xmin, ymin, xmax, ymax. Axis x merges
columns, axis y rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed
from .ranges import numbered_groups

DETECTED, STRUCTURED = 0.7, 0.5
TABLE_LABELS, ROW_LABEL, COLUMN_LABEL = ("table", "table rotated"), "table row", "table column"
PADDING, SCALE = 10, 200 / 72


def detected(objects: DataFrame, labels: tuple[str, ...], threshold: float) -> DataFrame:
    return objects.where(F.col("label").isin(*labels) & (F.col("score") > threshold))


def merge_intervals(objects: DataFrame, axis: str, key: str = "table_id", rows: int | None = None) -> DataFrame:
    """(key, group_no, label, score, box): objects whose intervals touch or overlap as one, with their hull, best score and first label.

    With rows, a key of more objects is worked on in ranges of about so many; without, a key is one task's.
    """
    other = "y" if axis == "x" else "x"
    lo, hi = f"{axis}min", f"{axis}max"
    if rows:
        grouped = numbered_groups(objects, [key], lo, hi, "object_id", rows)
    else:
        order = Window.partitionBy(key).orderBy(lo, "object_id")
        reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
        grouped = objects.withColumn("__new", F.coalesce(F.col(lo) > reach, F.lit(True)).cast("int")).withColumn("group_no", F.sum("__new").over(order).cast("long"))
    return grouped.groupBy(key, "group_no").agg(
        F.min_by("label", F.struct(lo, "object_id")).alias("label"), F.max("score").alias("score"),
        F.min(lo).alias(lo), F.max(hi).alias(hi), F.min(f"{other}min").alias(f"{other}min"), F.max(f"{other}max").alias(f"{other}max"),
    )


def fill_gaps(merged: DataFrame, axis: str, low: Column, high: Column, key: str = "table_id", large: bool = False) -> DataFrame:
    """Neighbours meet half-way; the first and last reach the table's edges.

    Neighbours are found by a window over a key's groups, or for large keys, whose groups are numbered without gaps, by joins on their numbers.
    """
    lo, hi = f"{axis}min", f"{axis}max"
    if large:
        edge = lambda c, by, name: merged.select(key, (F.col("group_no") + by).alias("group_no"), F.col(c).alias(name))
        merged = merged.join(edge(hi, 1, "__before"), [key, "group_no"], "left").join(edge(lo, -1, "__after"), [key, "group_no"], "left")
        before, after = F.col("__before"), F.col("__after")
    else:
        order = Window.partitionBy(key).orderBy("group_no")
        before, after = F.lag(hi).over(order), F.lead(lo).over(order)
    middle = lambda a, b: (a + b) / 2
    return merged.withColumns(
        {
            lo: F.coalesce(middle(before, F.col(lo)), low),
            hi: F.coalesce(middle(F.col(hi), after), high),
        }
    ).drop("__before", "__after")


def grid_cells(rows: DataFrame, columns: DataFrame, tables: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, row_no, col_no, box): each row with each column of its table."""
    r, c = grid_sides(rows, columns, tables, key)
    return r.join(c, key)


def grid_sides(rows: DataFrame, columns: DataFrame, tables: DataFrame, key: str = "table_id") -> tuple[DataFrame, DataFrame]:
    """(key, row_no, ymin, ymax) and (key, col_no, xmin, xmax): rows merged and filled along y, columns along x."""
    edges = lambda df: df.join(tables.select(key, "t_xmin", "t_ymin", "t_xmax", "t_ymax"), key)
    r = fill_gaps(edges(merge_intervals(rows, "y", key)), "y", F.col("t_ymin"), F.col("t_ymax"), key)
    c = fill_gaps(edges(merge_intervals(columns, "x", key)), "x", F.col("t_xmin"), F.col("t_xmax"), key)
    return r.select(key, F.col("group_no").alias("row_no"), "ymin", "ymax"), c.select(key, F.col("group_no").alias("col_no"), "xmin", "xmax")


def to_points(v: Column, offset: Column, scale: float = SCALE) -> Column:
    """Pixels of a crop to points of the page."""
    return (v + offset) / scale


def padded(objects: DataFrame, width: Column, height: Column, by: float = PADDING) -> DataFrame:
    """Boxes with a margin, inside the image."""
    return objects.withColumns(
        {
            "xmin": F.greatest(F.lit(0.0), F.col("xmin") - by), "ymin": F.greatest(F.lit(0.0), F.col("ymin") - by),
            "xmax": F.least(width.cast("double"), F.col("xmax") + by), "ymax": F.least(height.cast("double"), F.col("ymax") + by),
        }
    )


def inside(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, key: str) -> DataFrame:
    """points with the columns of each interval [low, high) of their key that they lie in.

    A range search by buckets as wide as a key's intervals are on average: an interval
    is in the buckets that it touches, some two if intervals don't overlap much, and a
    point meets the intervals of its own bucket only. Points without a place, and
    empty intervals, meet none.
    """
    some = intervals.where(F.col(low) < F.col(high))
    facts = F.min(low), (F.max(high) - F.min(low)) / F.count("*")
    bounds = some.groupBy(key).agg(facts[0].alias("__base"), facts[1].alias("__width"))
    own = Window.partitionBy(key)
    wide = some.withColumns({"__base": F.min(low).over(own), "__width": (F.max(high).over(own) - F.min(low).over(own)) / F.count("*").over(own)})
    bucket = lambda c: F.floor((F.col(c) - F.col("__base")) / F.col("__width"))
    cut = wide.withColumn("__bucket", F.explode(F.sequence(bucket(low), bucket(high)))).drop("__base", "__width")
    placed = points.where(F.col(at).isNotNull()).join(bounds, key).withColumn("__bucket", bucket(at)).drop("__base", "__width")
    return placed.join(cut, [key, "__bucket"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__bucket")


def placed_words(words: DataFrame, key: str) -> DataFrame:
    """(key, word_no, cx, cy, word): words (key, word_no, x0, y0, x1, y1, text) with their centres."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return words.select(key, "word_no", x.alias("cx"), y.alias("cy"), F.col("text").alias("word"))


def texts_of_cells(cells: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, row_no, col_no, text) of words found (key, row_no, col_no, word_no, word), in order; empty cells are kept."""
    one = collapsed(F.array_join(F.array_sort(F.collect_list(F.struct("word_no", "word")))["word"], " ")).alias("text")
    texts = found.groupBy(key, "row_no", "col_no").agg(one)
    return cells.join(texts, [key, "row_no", "col_no"], "left").select(key, "row_no", "col_no", F.coalesce("text", F.lit("")).alias("text"))


def cell_texts(cells: DataFrame, words: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, row_no, col_no, text): words (key, word_no, x0, y0, x1, y1, text) whose centre lies in a cell.

    A word meets each cell of its table: cells of any kind, few of them a table. For large grids grid_texts() searches ranges.
    """
    within = (F.col("cx") >= F.col("xmin")) & (F.col("cx") < F.col("xmax")) & (F.col("cy") >= F.col("ymin")) & (F.col("cy") < F.col("ymax"))
    return texts_of_cells(cells, cells.join(placed_words(words, key), key).where(within), key)


def grid_texts(rows: DataFrame, columns: DataFrame, words: DataFrame, key: str = "table_id") -> DataFrame:
    """cell_texts() of a grid given by its sides, as grid_sides() gives them: a word finds its row by y and its column by x, and never meets the other cells."""
    found = inside(inside(placed_words(words, key), "cy", rows, "ymin", "ymax", key), "cx", columns, "xmin", "xmax", key)
    return texts_of_cells(rows.select(key, "row_no").join(columns.select(key, "col_no"), key), found, key)


def candidates(texts: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, rows, detected_rows, detected_cols) from cell texts."""
    by_row = texts.groupBy(key, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "text")))["text"].alias("row"))
    return by_row.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row_no", "row")))["row"].alias("rows")).select(
        key, "rows", F.size("rows").alias("detected_rows"), F.coalesce(F.size(F.get("rows", F.lit(0))), F.lit(0)).alias("detected_cols")
    )
