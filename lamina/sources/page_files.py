"""Long files page by page: the unit of work is a range of pages, so a large file is many tasks.

Files are opened where their pages are worked on, as seekable streams, and never pass
the driver or a shuffle. What is in a page is the business of functions given by the
caller: count(file), decode(file, page), render(file, page, dpi). Pages count from 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import file_stem
from .files import BLOCKS, _files
from .session import ready

#: Pages of a range; ranges of a task.
PAGES_A_RANGE, RANGES_A_TASK = 50, 1
DPI = 200
COUNTS = "doc_id string, path string, n_pages int, error string"
IMAGES = "doc_id string, page int, width int, height int, image binary, error string"

Opener = Callable[[str], BinaryIO]


def opened(path: str) -> BinaryIO:
    """A mounted file, or one in a store that Arrow knows (s3, gs, hdfs)."""
    from urllib.parse import quote

    from pyarrow import fs

    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    system, name = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return system.open_input_file(name)


def _rows(found: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{c: row.get(c) for c in schema.names} for row in found], schema)


def page_counts(spark: SparkSession, pattern: str, count: Callable[[BinaryIO], int], opener: Opener = opened) -> DataFrame:
    """(doc_id, path, n_pages, error) of the files that a glob matches, FileNotFoundError if none; a file that can't be read has its error and no pages."""
    _files(spark, pattern)
    schema = to_arrow_schema(StructType.fromDDL(COUNTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.to_pylist()
            for row in found:
                try:
                    with opener(row["path"]) as file:
                        row["n_pages"] = count(file)
                except Exception as e:
                    row["error"] = str(e) or type(e).__name__
            yield _rows(found, schema)

    files = ready(spark).read.format("binaryFile").load(pattern)  # no contents: columns are pruned
    return files.select(file_stem(F.col("path")).alias("doc_id"), "path").mapInArrow(run, COUNTS)


def page_ranges(counts: DataFrame, pages: int = PAGES_A_RANGE, tasks: int | None = None) -> DataFrame:
    """(doc_id, path, first, last, error) of page_counts(), dealt to tasks; files without pages give none, files with an error one range with it.

    Without a number of tasks the pages are counted once more to find it.
    """
    at = F.explode(F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast("int"))).when(F.col("n_pages") > 0, F.expr(f"sequence(1, n_pages, {int(pages)})")))
    ranges = counts.select("doc_id", "path", "n_pages", "error", at.alias("first"))
    ranges = ranges.select("doc_id", "path", "first", F.least(F.col("first") + (pages - 1), F.col("n_pages")).alias("last"), "error")
    return ranges.repartition(tasks or max(1, -(-ranges.count() // RANGES_A_TASK)), "path", "first")


def pages_asked(asked: DataFrame) -> DataFrame:
    """Ranges of single pages from (doc_id, path, page); a page asked for twice is one."""
    return asked.select("doc_id", "path", F.col("page").cast("int").alias("first"), F.col("page").cast("int").alias("last"), F.lit(None).cast("string").alias("error")).distinct()


def of_pages(ranges: DataFrame, each: Callable[[BinaryIO, int], list[dict[str, Any]]], schema: str, opener: Opener = opened) -> DataFrame:
    """Rows (doc_id, page, the columns that each() gives, error) of all pages of ranges.

    A range opens its file once and works page by page; one page's rows are held at a time. A page that fails gives
    one row with its error and the others stay; where the file can't be opened, each page of the range does.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def work(row: dict) -> Iterator[list[dict]]:
        failed = lambda page, e: [{"doc_id": row["doc_id"], "page": page, "error": str(e) or type(e).__name__}]
        if row["error"] is not None:
            yield failed(None, row["error"])
            return
        span = range(row["first"], row["last"] + 1)
        try:
            file = opener(row["path"])
        except Exception as e:
            yield from (failed(page, e) for page in span)
            return
        with file:
            for page in span:
                try:
                    yield [{**r, "doc_id": row["doc_id"], "page": page} for r in each(file, page)]
                except Exception as e:
                    yield failed(page, e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for found in work(row):
                    yield _rows(found, arrow)

    return ranges.mapInArrow(run, schema)


def page_blocks(ranges: DataFrame, decode: Callable[[BinaryIO, int], list[dict]], opener: Opener = opened) -> DataFrame:
    """blocks of each page: decode gives a dict for each, as decoded() of whole files takes them."""
    return of_pages(ranges, decode, BLOCKS, opener)


def page_images(ranges: DataFrame, render: Callable[[BinaryIO, int, int], tuple[int, int, bytes]], dpi: int = DPI, opener: Opener = opened) -> DataFrame:
    """(doc_id, page, width, height, image, error): render gives width, height and bytes of a page at a resolution."""

    def each(file: BinaryIO, page: int) -> list[dict]:
        return [dict(zip(("width", "height", "image"), render(file, page, dpi), strict=True))]

    return of_pages(ranges, each, IMAGES, opener)
