"""Pages to sections to size-bounded, classified and linked chunks.

Relations: pages (doc_id, page, text); lines (doc_id, page, line_no, line);
chunks (chunk_id, doc_id, ordinal, page_start, page_end, section_title,
coverage_type, text, char_count, matched_category, secondary_category,
matched_keyword, related_chunk_id). Everything is partitioned by doc_id, so one
exchange serves all windows and aggregates of a pipeline. Folds see lengths and
categories only; texts are joined afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import Rules
from ..functions.text import chunk_name, clean_lines

CHUNK_COLUMNS = [
    "chunk_id", "doc_id", "ordinal", "page_start", "page_end", "section_title", "coverage_type", "text", "char_count",
    "matched_category", "secondary_category", "matched_keyword", "related_chunk_id",
]


def in_order(*columns: str):
    return Window.partitionBy("doc_id").orderBy(*columns)


def long_length(c: Column) -> Column:
    return F.length(c).cast("long")


def with_lines(pages: DataFrame) -> DataFrame:
    """pages with their stripped non-blank lines, as generated rows, below which no filter on them is pushed: it would split the texts again."""
    return pages.select("*", F.explode(F.array(clean_lines(F.col("text")))).alias("__lines"))


def _content(lined: DataFrame, rules: Rules) -> DataFrame:
    total = F.aggregate("__lines", F.lit(0), lambda n, x: n + F.length(x))
    return lined.where((F.size("__lines") >= rules.toc_lines) & (total >= rules.toc_chars * F.size("__lines")))


def content_lines(pages: DataFrame, rules: Rules) -> DataFrame:
    """content_pages() with their lines in __lines."""
    return _content(with_lines(pages), rules)


def content_pages(pages: DataFrame, rules: Rules) -> DataFrame:
    """Without tables of contents: pages of few lines, or of short lines on average."""
    return content_lines(pages, rules).drop("__lines")


def flat_lines(pages: DataFrame) -> DataFrame:
    """Stripped non-blank lines in order; line_no counts within the document."""
    return _numbered(with_lines(pages))


def _numbered(lined: DataFrame) -> DataFrame:
    rows = lined.select("doc_id", "page", F.posexplode("__lines").alias("at", "line"))
    order = in_order("page", "at")
    return rows.select("doc_id", F.col("page").cast("long").alias("page"), F.row_number().over(order).cast("long").alias("line_no"), "line")


def sections(lines: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, ordinal, page_start, page_end, section_title, text): a title line starts a section and is part of it.

    A section ends on the page of the next title, the last one on the document's last page.
    """
    order = in_order("line_no")
    marked = (
        lines.withColumn("is_title", rules.is_title(F.col("line")))
        .withColumn("section", F.sum(F.col("is_title").cast("int")).over(order))
        .withColumn("last_page", F.max("page").over(Window.partitionBy("doc_id")))
    )
    packed = marked.groupBy("doc_id", "section").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"),
        F.min("page").alias("page_start"),
        F.max("last_page").alias("last_page"),
        F.max("is_title").alias("titled"),
    )
    first = F.get("rows", F.lit(0))["line"]
    by_section = in_order("section")
    return packed.select(
        "doc_id",
        F.row_number().over(by_section).cast("long").alias("ordinal"),
        "page_start",
        F.coalesce(F.lead("page_start").over(by_section), "last_page").alias("page_end"),
        F.when(F.col("titled"), rules.title_of(first)).otherwise(rules.preamble).alias("section_title"),
        F.array_join("rows.line", "\n").alias("text"),
    )


def raw_chunks(pages: DataFrame, rules: Rules) -> DataFrame:
    """Sections of content pages with name, category and coverage type."""
    return described(sections(_numbered(content_lines(pages, rules)), rules), rules)


def described(found: DataFrame, rules: Rules, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sections as chunks, with the columns in keep. The categories are generated rows, below which no filter on them is pushed: it would search the texts again."""
    return (
        found.select("*", F.inline(F.array(rules.category(F.col("section_title"), F.col("text")))))
        .withColumn("chunk_id", chunk_name(F.col("doc_id").cast("string"), F.col("ordinal")))
        .withColumn("char_count", long_length(F.col("text")))
        .withColumn("coverage_type", rules.coverage_type(F.col("section_title"), F.col("text")))
        .withColumn("related_chunk_id", F.lit(None).cast("string"))
        .select(*keep, *CHUNK_COLUMNS)
    )


#: Values of a list's last piece at most, in a fold.
PIECE = 256


def empty_list() -> Column:
    """A list that a fold adds to in pieces, since appending copies an array: a value costs a piece's copy, not the list's."""
    return F.struct(F.array().cast("array<array<int>>").alias("pieces"), F.array().cast("array<int>").alias("last"))


def added(values: Column, x: Column) -> Column:
    full = F.size(values["last"]) >= PIECE
    return F.struct(
        F.when(full, F.array_append(values["pieces"], values["last"])).otherwise(values["pieces"]).alias("pieces"),
        F.when(full, F.array(x)).otherwise(F.array_append(values["last"], x)).alias("last"),
    )


def listed(values: Column) -> Column:
    return F.flatten(F.array_append(values["pieces"], values["last"]))


def group_list(facts: Column, rules: Rules) -> Column:
    """Group numbers of an array of facts (size, category, ...) in their order."""
    start = F.struct(
        empty_list().alias("groups"), F.lit(0).alias("group"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("category")
    )

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["size"] < rules.small) & F.coalesce(acc["category"] == x["category"], F.lit(True))
        joins = (acc["group"] > 0) & fits
        group = F.when(joins, acc["group"]).otherwise(acc["group"] + 1)
        return F.struct(
            added(acc["groups"], group).alias("groups"),
            group.alias("group"),
            F.when(joins, acc["size"] + 1 + x["size"]).otherwise(x["size"]).alias("size"),
            F.when(joins, F.coalesce(acc["category"], x["category"])).otherwise(x["category"]).alias("category"),
        )

    return listed(F.aggregate(facts, start, step)["groups"])


def group_numbers(facts: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """(keys, ordinal, group) of facts (keys, ordinal, size, category): a fold over each key's chunks."""
    each = F.array_sort(F.collect_list(F.struct("ordinal", "size", "category")))
    folded = facts.groupBy(*keys).agg(each.alias("facts")).select(*keys, "facts", group_list(F.col("facts"), rules).alias("groups"))
    pairs = F.explode(F.arrays_zip(F.col("facts.ordinal").alias("ordinal"), F.col("groups").alias("group")))
    return folded.select(*keys, pairs.alias("x")).select(*keys, "x.ordinal", "x.group")


def merge_facts(chunks: DataFrame) -> DataFrame:
    """What the merging of chunks depends on."""
    return chunks.select("doc_id", "ordinal", F.col("char_count").alias("size"), F.nullif(F.col("matched_category"), F.lit("")).alias("category"))


def joined_groups(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """A chunk for each group of groups (doc_id, ordinal, and what tells groups apart)."""
    return grouped(chunks.join(groups, ["doc_id", "ordinal"]), ["doc_id", *[c for c in groups.columns if c not in ("doc_id", "ordinal")]]).select(CHUNK_COLUMNS)


def grouped(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, and what a chunk has): a chunk for each of the keys."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    first = lambda c: F.min_by(c, "ordinal").alias(c)
    given = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("ordinal"))).alias(c)
    found = chunks.groupBy(*keys).agg(
        first("chunk_id"), F.min("ordinal").alias("ordinal"), first("page_start"), F.max_by("page_end", "ordinal").alias("page_end"),
        first("section_title"), first("coverage_type"), F.array_join(rows["text"], "\n").alias("text"),
        given("matched_category"), given("secondary_category"), given("matched_keyword"), first("related_chunk_id"),
    )
    return found.withColumn("char_count", long_length(F.col("text")))


def merge_small(chunks: DataFrame, rules: Rules) -> DataFrame:
    """A chunk below the least size takes in the chunks that follow while it is, and categories are equal or missing.

    The fold over a document's (length, category) gives group numbers; then
    groups are joined. Category, secondary and keyword are each the first given.
    """
    return joined_groups(chunks, group_numbers(merge_facts(chunks), ["doc_id"], rules))


def reclassified(chunks: DataFrame, rules: Rules) -> DataFrame:
    return chunks.withColumn("coverage_type", rules.coverage_type(F.col("section_title"), F.col("text")))


def parts_of(text: Column, most: int) -> Column:
    """Array of parts of at most `most` characters: whole lines packed greedily, longer lines cut."""
    start = F.struct(empty_list().alias("starts"), F.lit(0).alias("n"), F.lit(0).alias("size"))

    def step(acc: Column, line: Column) -> Column:
        """starts: numbers of the lines that open a part, but for the first."""
        opens = (acc["size"] > 0) & (acc["size"] + F.length(line) + 1 > most)
        return F.struct(
            F.when(opens, added(acc["starts"], acc["n"])).otherwise(acc["starts"]).alias("starts"), (acc["n"] + 1).alias("n"),
            (F.when(opens, F.lit(0)).otherwise(acc["size"]) + F.length(line) + 1).alias("size"),
        )

    def packed(lines: Column) -> Column:
        edges = F.concat(F.array(F.lit(0)), listed(F.aggregate(lines, start, step)["starts"]), F.array(F.size(lines)))

        def parts(at: Column) -> Column:
            whole = lambda p: F.array_join(F.slice(lines, F.get(at, p) + 1, F.get(at, p + 1) - F.get(at, p)), "\n")
            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda p: cut(whole(p))))

        return F.transform(F.array(edges), parts)[0]

    def cut(part: Column) -> Column:
        return F.transform(
            F.filter(F.sequence(F.lit(0), F.floor((F.length(part) - 1) / most).cast("int")), lambda _: F.length(part) > 0),
            lambda k: F.substring(part, k * most + 1, F.lit(most)),
        )

    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.transform(F.array(F.split(text, "\n")), packed)[0])


def split_large(chunks: DataFrame, rules: Rules) -> DataFrame:
    """Chunks over the greatest size in parts; the first keeps its name, the others get _2, _3, ..."""
    parts = chunks.select("*", F.posexplode(parts_of(F.col("text"), rules.large)).alias("part", "piece"))
    return named_parts(parts, F.row_number().over(in_order("ordinal", "part")).cast("long"))


def part_name(chunk_id: Column, part: Column) -> Column:
    return F.when(part == 0, chunk_id).otherwise(F.concat(chunk_id, F.lit("_"), (part + 1).cast("string")))


def named_parts(parts: DataFrame, ordinal: Column) -> DataFrame:
    """Chunks of parts (chunks with part, piece), under their new ordinals."""
    return (
        parts.withColumn("chunk_id", part_name(F.col("chunk_id"), F.col("part")))
        .withColumn("text", F.col("piece"))
        .withColumn("char_count", long_length(F.col("piece")))
        .withColumn("ordinal", ordinal)
        .select(CHUNK_COLUMNS)
    )


def link_pairs(chunks: DataFrame) -> DataFrame:
    """An included chunk right before an excluded one of the same category: each names the other."""
    order = in_order("ordinal")
    pair = lambda step: (step("matched_category").over(order) == F.col("matched_category"))
    to_next = (F.col("coverage_type") == "included") & (F.lead("coverage_type").over(order) == "excluded") & pair(F.lead)
    to_last = (F.col("coverage_type") == "excluded") & (F.lag("coverage_type").over(order) == "included") & pair(F.lag)
    linked = F.when(to_next, F.lead("chunk_id").over(order)).when(to_last, F.lag("chunk_id").over(order))
    return chunks.withColumn("related_chunk_id", linked)


def chunk_pipeline(pages: DataFrame, rules: Rules) -> DataFrame:
    """raw, merged, reclassified, split, linked."""
    found = reclassified(merge_small(raw_chunks(pages, rules), rules), rules)
    return link_pairs(split_large(found, rules))
