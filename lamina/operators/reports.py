"""Summaries of chunks and recall of table contents."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compare_form, preview

TINY, THRESHOLD = 100, 0.7
COVERAGE_TYPES = ("included", "excluded", "procedure", "definition")


def category_histogram(chunks: DataFrame) -> DataFrame:
    """(matched_category, n, first): most frequent first, ties in order of first appearance."""
    return (
        chunks.where("matched_category is not null").groupBy("matched_category")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "ordinal")).alias("first"))
        .select("matched_category", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.ordinal").alias("first_ordinal"))
        .orderBy(F.desc("n"), "first_doc", "first_ordinal")
    )


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """total, matched, unmatched and their share (null without chunks)."""
    matched = F.count_if(F.col("matched_category").isNotNull())
    return chunks.agg(F.count("*").alias("total"), matched.alias("matched"), (F.count("*") - matched).alias("unmatched")).withColumn(
        "matched_share", F.try_divide("matched", "total")
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Counts for each document: chunks, matched, tiny, linked, each coverage type, categories in order."""
    kinds = [F.count_if(F.col("coverage_type") == k).alias(f"n_{k}") for k in COVERAGE_TYPES]
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.count_if(F.col("matched_category").isNotNull()).alias("n_matched"),
        F.count_if(F.col("char_count") < TINY).alias("n_tiny"), F.count_if(F.col("related_chunk_id").isNotNull()).alias("n_linked"), *kinds,
        F.array_join(F.array_sort(F.collect_set("matched_category")), ",").alias("categories"),
    ).withColumn("matched_share", F.try_divide("n_matched", "n_chunks"))


def chunk_previews(chunks: DataFrame, matched: int = 20, unmatched: int = 10) -> DataFrame:
    """The first chunks with and without a category, with the start of their texts. Both are found in one pass over chunks, of which a task hands on the first ones only."""
    without = F.col("matched_category").isNull()
    shown = chunks.select("doc_id", "ordinal", "chunk_id", "section_title", "matched_category", preview(F.col("text")).alias("preview"), without.alias("__without"))
    at = F.row_number().over(Window.partitionBy("__without").orderBy("doc_id", "ordinal"))
    first = shown.withColumn("__at", at).where(F.col("__at") <= max(matched, unmatched))
    kept = first.where(F.col("__at") <= F.when(F.col("__without"), unmatched).otherwise(matched))
    return kept.orderBy("__without", "__at").select("chunk_id", "section_title", "matched_category", "preview")


def page_stats(pages: DataFrame) -> DataFrame:
    """Characters and pages that are not empty, for each document."""
    return pages.groupBy("doc_id").agg(F.sum(F.length("text")).alias("total_chars"), F.count_if(F.length("text") > 0).alias("n_pages"))


class CellAutomaton:
    """All substrings of a table's cells, as the states of a suffix automaton. A text runs through it once, for all cells.

    A state stands for substrings that end at the same places of the cells, of lengths
    link's + 1 to its own. It has some two states a character of the cells, whatever
    the texts' length; a text costs a step for each of its characters.
    """

    def __init__(self, cells: list[str]):
        self.after: list[dict[str, int]] = [{}]
        self.size, self.link = [0], [-1]
        self.path: dict[str, list[int]] = {}  # the states of a cell's prefixes
        for cell in dict.fromkeys(cells):
            at, path = 0, []
            for c in cell:
                at = self._extended(at, c)
                path.append(at)
            self.path[cell] = path
        for cell in self.path:  # a state that was split since is no longer its prefix's
            at, path = 0, []
            for c in cell:
                at = self.after[at][c]
                path.append(at)
            self.path[cell] = path
        self.by_size = sorted(range(1, len(self.size)), key=self.size.__getitem__)

    def _added(self, size: int, after: dict[str, int], link: int) -> int:
        self.size.append(size)
        self.after.append(after)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, at: int, c: str) -> int:
        """The state that at and c lead to, for no longer substring than that."""
        to = self.after[at][c]
        if self.size[to] == self.size[at] + 1:
            return to
        short = self._added(self.size[at] + 1, dict(self.after[to]), self.link[to])
        self.link[to] = short
        while at >= 0 and self.after[at].get(c) == to:
            self.after[at][c] = short
            at = self.link[at]
        return short

    def _extended(self, last: int, c: str) -> int:
        if c in self.after[last]:
            return self._split(last, c)
        new, at = self._added(self.size[last] + 1, {}, 0), last
        while at >= 0 and c not in self.after[at]:
            self.after[at][c] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, c)
        return new

    def longest_in(self, text: str) -> list[int]:
        """For each state, the longest substring of it, or else of its links, that text holds."""
        after, link, size = self.after, self.link, self.size
        most = [0] * len(size)
        at = n = 0
        for c in text:
            to = after[at].get(c)
            while to is None and at:
                at = link[at]
                n = size[at]
                to = after[at].get(c)
            if to is None:
                n = 0
                continue
            at, n = to, n + 1
            if n > most[at]:
                most[at] = n
        for v in reversed(self.by_size):  # what holds a substring holds its ends
            if most[v] and (up := link[v]):
                most[up] = size[up]
        for v in self.by_size:
            if not most[v]:
                most[v] = most[link[v]]
        return most

    def shares(self, text: str) -> dict[str, float]:
        """Of each cell, the part that matching blocks with text cover; an empty cell is found, in an empty text nothing else is."""
        most = self.longest_in(text)
        found = {}
        for cell, path in self.path.items():
            ends = [most[v] for v in path]
            found[cell] = 1.0 if not cell or (ends[-1] == len(cell)) else covered(cell, text, ends) / len(cell)
        return found


def covered(a: str, b: str, ends: list[int]) -> int:
    """Characters of a that matching blocks with b cover: the longest common substring (the first in a, then in b), and so on before and after it.

    ends: for each character of a, the longest substring that ends there and is in b
    at all. In a part of b it is a bound: only ends that reach a length are looked for.
    A common substring's parts are common too, so the length is found by bisection.
    """
    total, open_parts = 0, [(0, len(a), 0, len(b))]
    while open_parts:
        a_from, a_to, b_from, b_to = open_parts.pop()
        bound = [min(ends[i], i + 1 - a_from, b_to - b_from) for i in range(a_from, a_to)]
        low, high, at = 0, max(bound, default=0), None

        def first(size: int, a_from=a_from, b_from=b_from, b_to=b_to, bound=bound) -> tuple[int, int] | None:
            for n, most in enumerate(bound, a_from + 1):
                if most >= size and (j := b.find(a[n - size : n], b_from, b_to)) >= 0:
                    return n - size, j
            return None

        middle = high  # the bound itself is the likeliest
        while low < high:
            if found := first(middle):
                low, at = middle, found
            else:
                high = middle - 1
            middle = (low + high + 1) // 2
        if low:
            total += low
            open_parts += [(a_from, at[0], b_from, at[1]), (at[0] + low, a_to, at[1] + low, b_to)]
    return total


def shared_chars(a: str, b: str) -> int:
    """Characters of a in matching blocks with b."""
    automaton = CellAutomaton([a])
    most = automaton.longest_in(b)
    return covered(a, b, [most[v] for v in automaton.path[a]])


def share(truth: str, found: str) -> float:
    """Part of truth that matching blocks cover; an empty truth is found, in an empty text nothing is."""
    return CellAutomaton([truth]).shares(found)[truth]


#: Tables whose automata a task keeps at most: a table's candidates mostly come together.
KEPT_AUTOMATA = 64


def shares_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of each row's texts the shares in its other text. Batches stay Arrow's: only one row at a time is Python strings and floats."""
    kept: dict[tuple[str, ...], CellAutomaton] = {}
    for many, texts in batches:
        ratios, ends = array("d"), array("i", [0])
        for cells, text in zip(many, texts, strict=True):
            key = tuple(c or "" for c in cells.as_py())
            if key not in kept:
                if len(kept) >= KEPT_AUTOMATA:
                    kept.clear()
                kept[key] = CellAutomaton(list(key))
            of = kept[key].shares(text.as_py() or "")
            ratios.extend(of[c] for c in key)
            ends.append(len(ratios))
        many = texts = cells = text = None  # or the next batch comes beside this one
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ratios, pa.float64()))


def containments(truths: Column, found: Column) -> Column:
    """Of each of an array of texts the share of its characters in matching blocks with found, white space aside."""

    def shares(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return shares_of(batches)

    return F.arrow_udf(shares, "array<double>")(F.transform(truths, compare_form), compare_form(found))


def containment(truth: Column, found: Column) -> Column:
    return F.get(containments(F.array(truth), found), F.lit(0))


def exact_containments(truths: Column, found: Column) -> Column:
    """1 for each text that found holds whole, white space aside, else 0."""
    bare = F.transform(F.array(F.coalesce(compare_form(found), F.lit(""))), lambda f: F.transform(truths, lambda t: F.contains(f, compare_form(t)).cast("double")))
    return F.get(bare, F.lit(0))


def recall(scored: DataFrame, key: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_cells, recall): share of cells (key, ratio) at the threshold or over it."""
    return scored.groupBy(*key).agg(F.count("*").alias("n_cells"), F.avg((F.col("ratio") >= threshold).cast("double")).alias("recall"))


def cells_of(truth: DataFrame, key: list[str]) -> DataFrame:
    """(key, cells): the cells of a table as an array; the order says nothing. Null cells are empty ones, which are found anywhere."""
    return truth.groupBy(*key).agg(F.collect_list(F.coalesce("cell", F.lit(""))).alias("cells"))  # one table


def passed(ratios: Column, threshold: float = THRESHOLD) -> Column:
    """Share of ratios at the threshold or over it; null of none."""
    return F.try_divide(F.size(F.filter(ratios, lambda r: r >= threshold)).cast("double"), F.size(ratios).cast("double"))


def scored_candidates(truth: DataFrame, candidates: DataFrame, ratios=containments) -> DataFrame:
    """candidates (table_id, candidate, text, ...) with n_cells and recall against truth (table_id, cell), without their texts. A text meets its table's cells once, as an array."""
    found = candidates.join(cells_of(truth, ["table_id"]), "table_id").withColumn("ratios", ratios(F.col("cells"), F.col("text")))
    return found.withColumn("n_cells", F.size("ratios")).withColumn("recall", passed(F.col("ratios"))).drop("text", "cells", "ratios")


def best_of(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """(table_id, recall, candidate, n_candidates, and scored's other columns) of each table's candidate of most recall, the first on ties."""
    others = [c for c in scored.columns if c not in ("table_id", "recall", "candidate", "n_cells")]
    best = scored.groupBy("table_id").agg(
        F.max_by(F.struct("recall", "candidate", *others), F.struct("recall", -F.col("candidate"))).alias("best"), F.count("*").alias("n_candidates")
    )
    return truth.select("table_id").distinct().join(best, "table_id", "left").select(
        "table_id", F.coalesce("best.recall", F.lit(0.0)).alias("recall"), F.col("best.candidate").alias("candidate"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        *[F.col("best")[c].alias(c) for c in others],
    )


def best_candidates(truth: DataFrame, candidates: DataFrame, ratios=containments) -> DataFrame:
    """(table_id, recall, candidate, n_candidates) for each table of truth (table_id, cell): the candidate (table_id, candidate, text) of most recall, the first on ties."""
    return best_of(scored_candidates(truth, candidates.select("table_id", "candidate", "text"), ratios), truth)


def page_recall(truth: DataFrame, pages: DataFrame, ratios=containments) -> DataFrame:
    """(table_id, n_cells, layout_recall) of truth (table_id, pdf, page, cell) in the text of its page, of pages (pdf, page, text); a table without its page has no row."""
    found = cells_of(truth, ["table_id", "pdf", "page"]).join(pages.select("pdf", "page", "text"), ["pdf", "page"])
    scored = found.withColumn("ratios", ratios(F.col("cells"), F.col("text")))
    return scored.select("table_id", F.size("ratios").alias("n_cells"), passed(F.col("ratios")).alias("layout_recall"))


def seconds_per_page(timings: DataFrame, pages: DataFrame) -> DataFrame:
    """(pdf, seconds_per_page): seconds of timings (pdf, seconds) over the document's number of pages."""
    n = pages.groupBy("pdf").agg(F.count_distinct("page").alias("n_pages"))
    return timings.groupBy("pdf").agg(F.sum("seconds").alias("seconds")).join(n, "pdf").select("pdf", (F.col("seconds") / F.col("n_pages")).alias("seconds_per_page"))


def evaluation(tables: DataFrame, pages: DataFrame, timings: DataFrame, results: DataFrame) -> DataFrame:
    """The rows of the report on two extraction methods, by table.

    tables: table_id, pdf, page, columns, rows (array of arrays of cells). results: table_id, seconds, candidates (array of structs
    with rows, detected_rows, detected_cols). A table that a method found nothing for has a recall of 0 there.
    """
    truth = tables.select("table_id", "pdf", "page", F.explode(F.flatten("rows")).alias("cell"))
    found = results.select("table_id", F.posexplode("candidates").alias("candidate", "c")).select(
        "table_id", "candidate", candidate_text(F.col("c.rows")).alias("text"), F.col("c.detected_rows").alias("detected_rows"), F.col("c.detected_cols").alias("detected_cols")
    )
    best = best_of(scored_candidates(truth, found), truth).withColumnsRenamed({"recall": "model_recall"}).drop("candidate")
    return (
        tables.select("table_id", "pdf", "page", F.size(F.flatten("rows")).alias("truth_cells"), F.size("rows").alias("truth_rows"), F.size("columns").alias("truth_cols"))
        .join(page_recall(truth, pages).drop("n_cells"), "table_id", "left").fillna({"layout_recall": 0.0})
        .join(seconds_per_page(timings, pages).withColumnRenamed("seconds_per_page", "layout_seconds_per_page"), "pdf", "left")
        .join(results.select("table_id", F.col("seconds").alias("model_seconds")), "table_id", "left")
        .join(best, "table_id", "left")
    )


def recall_report(layout: DataFrame, model: DataFrame) -> DataFrame:
    """Both methods' rows by table_id, and a last row (table_id null) of means."""
    joined = layout.join(model, "table_id")
    numbers = [c for c, kind in joined.dtypes if c != "table_id" and kind in ("double", "bigint", "int")]
    means = joined.agg(*[F.avg(c).alias(c) for c in numbers]).withColumn("table_id", F.lit(None).cast(dict(joined.dtypes)["table_id"]))
    return joined.select("table_id", *[F.col(c).cast("double").alias(c) for c in numbers]).unionByName(means)


def candidate_text(rows: Column) -> Column:
    """All cells of an array of rows, a line each."""
    return F.array_join(F.flatten(rows), "\n")
