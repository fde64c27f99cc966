"""The chunk pipeline for documents of any length: no window or fold holds a document.

The results are chunk_pipeline()'s. A document is cut into segments, the unit of windows and folds here: the first place
in a range of pages where a title follows the end of a section that is large enough by itself, so that whatever stands
before merges with nothing behind it, starts a segment. Texts are dealt once, by segments; what a segment needs of those
before and behind it (numbers of sections and parts, the chunks at their ends) is a row of a small table, for which the
documents of several segments are gone through once more. Others have one segment and need none of it.

Documents with a segment of more than MOST characters, as where thousands of pages have small sections only, go
another way, which costs many times the disk: numbers of sections and chunks are running sums over ranges of pages or
chunks, with what the ranges before amount to carried in. Neighbours are found by joins on these numbers. For
small chunks, a document falls into runs that merge independently: whatever stands before, a chunk after one that
is large enough by itself starts a group, since that one ends its own; and so does a chunk whose category
differs from the last one's, since that one's group has its category. The fold takes a run at a time. A section
is one text, so a section must fit a task; as must the sizes of a run, some bytes a chunk.

Null document ids are left out. Pages of a document are told apart by their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import Rules
from ..functions.text import chunk_name, once
from . import chunks as C
from .ranges import running

#: Pages and chunks of a range.
PAGES, CHUNKS = 1000, 20_000

#: The range of pages without a number, before all others.
FIRST = -(1 << 62)

#: Characters of a segment at most.
MOST = 1 << 25

#: What a segment's rows are dealt by.
SEGMENT = ["doc_id", "segment"]


def neighbour(facts: DataFrame, by: int) -> DataFrame:
    """facts (doc_id, ordinal, ...) under the ordinal of the chunk `by` places further on, their names marked."""
    moved = facts.withColumn("ordinal", F.col("ordinal") + by)
    return moved.withColumnsRenamed({c: f"{'next' if by < 0 else 'last'}_{c}" for c in facts.columns if c not in ("doc_id", "ordinal")})


def sections(pages: DataFrame, rules: Rules, a_range: int = PAGES) -> DataFrame:
    """chunks.sections() of the content pages."""
    lined = C.content_lines(pages.where("doc_id is not null"), rules)
    lines = lined.select("doc_id", F.col("page").cast("long").alias("page"), F.posexplode("__lines").alias("at", "line"))
    marked = lines.withColumn("is_title", rules.is_title(F.col("line"))).withColumns(
        {"section": F.col("is_title").cast("long"), "__range": F.coalesce(F.floor(F.col("page") / a_range), F.lit(FIRST))}
    )
    numbered = running(marked, ["doc_id"], ["page", "at"], "section", nulls=False).drop("__range")
    packed = numbered.groupBy("doc_id", "section").agg(
        F.array_sort(F.collect_list(F.struct("page", "at", "line"))).alias("rows"), F.min("page").alias("page_start"), F.max("is_title").alias("titled")
    )
    following = numbered.where("is_title").select("doc_id", (F.col("section") - 1).alias("section"), F.col("page").alias("next_page"))
    pages_of = numbered.groupBy("doc_id", "section").agg(F.max("page").alias("last_page"))
    documents = pages_of.groupBy("doc_id").agg(F.max("last_page").alias("last_page"), F.min("section").alias("first_section"))
    ends = pages_of.select("doc_id", "section").join(following, ["doc_id", "section"], "left").join(documents, "doc_id")
    found = packed.join(ends, ["doc_id", "section"])  # texts stay where they were packed
    return found.select(
        "doc_id", (F.col("section") - F.col("first_section") + 1).alias("ordinal"), "page_start", F.coalesce("next_page", "last_page").alias("page_end"),
        F.when(F.col("titled"), rules.title_of(F.get("rows", F.lit(0))["line"])).otherwise(rules.preamble).alias("section_title"),
        F.array_join("rows.line", "\n").alias("text"),
    )


def merge_runs(facts: DataFrame, rules: Rules, a_range: int = CHUNKS) -> DataFrame:
    """(doc_id, ordinal, run, size, category): facts, whose ordinals have no gaps, with the first ordinal of their run."""
    beside = facts.join(neighbour(facts, 1), ["doc_id", "ordinal"], "left")
    opens = F.col("last_size").isNull() | (F.col("last_size") >= rules.small) | F.coalesce(F.col("category") != F.col("last_category"), F.lit(False))
    runs = beside.withColumns({"run": F.when(opens, F.col("ordinal")), "__range": F.floor(F.col("ordinal") / a_range)})
    return running(runs, ["doc_id"], ["ordinal"], "run", most=True).select("doc_id", "ordinal", "run", "size", "category")


def merge_small(chunks: DataFrame, rules: Rules, a_range: int = CHUNKS) -> DataFrame:
    """chunks.merge_small() of chunks whose ordinals have no gaps."""
    return C.joined_groups(chunks, C.group_numbers(merge_runs(C.merge_facts(chunks), rules, a_range), ["doc_id", "run"], rules))


def split_large(chunks: DataFrame, rules: Rules, a_range: int = CHUNKS) -> DataFrame:
    """chunks.split_large(): a chunk's parts are numbered from the parts of those before it."""
    cut = chunks.withColumn("__parts", C.parts_of(F.col("text"), rules.large)).drop("text").withColumns(
        {"__upto": F.size("__parts").cast("long"), "__range": F.floor(F.col("ordinal") / a_range)}
    )
    counted = running(cut, ["doc_id"], ["ordinal"], "__upto", nulls=False)
    parts = counted.select("*", F.posexplode("__parts").alias("part", "piece"))
    return C.named_parts(parts, F.col("__upto") - F.size("__parts") + F.col("part") + 1)


def link_pairs(chunks: DataFrame) -> DataFrame:
    """chunks.link_pairs() of chunks whose ordinals have no gaps."""
    facts = chunks.select("doc_id", "ordinal", "chunk_id", "coverage_type", "matched_category")
    both = chunks.join(neighbour(facts, 1), ["doc_id", "ordinal"], "left").join(neighbour(facts, -1), ["doc_id", "ordinal"], "left")
    pair = lambda own, side, other: (F.col("coverage_type") == own) & (F.col(f"{side}_coverage_type") == other) & (F.col(f"{side}_matched_category") == F.col("matched_category"))
    linked = F.when(pair("included", "next", "excluded"), F.col("next_chunk_id")).when(pair("excluded", "last", "included"), F.col("last_chunk_id"))
    return both.withColumn("related_chunk_id", linked).select(C.CHUNK_COLUMNS)


def by_sums(pages: DataFrame, rules: Rules, pages_a_range: int = PAGES, chunks_a_range: int = CHUNKS) -> DataFrame:
    """chunks.chunk_pipeline() by running sums, where a segment may be larger than a task."""
    raw = C.described(sections(pages, rules, pages_a_range), rules)
    merged = C.reclassified(merge_small(raw, rules, chunks_a_range), rules)
    return link_pairs(split_large(merged, rules, chunks_a_range))


def cut_place(lines: Column, rules: Rules) -> Column:
    """Number of the first line that is a title after rules.small characters of one section, all on this page; null if none is."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(None).cast("int").alias("at"))

    def step(acc: Column, line: Column) -> Column:
        def known(title: Column) -> Column:
            return F.struct(
                (acc["n"] + 1).alias("n"),
                F.when(title | (acc["n"] == 0), F.length(line)).otherwise(acc["size"] + 1 + F.length(line)).alias("size"),
                F.coalesce(acc["at"], F.when(title & (acc["n"] > 0) & (acc["size"] >= rules.small), acc["n"])).alias("at"),
            )

        return F.when(acc["at"].isNotNull(), acc).otherwise(once(rules.is_title(line), known))

    return F.aggregate(lines, start, step)["at"]


def cuts(lined: DataFrame, rules: Rules, a_range: int = PAGES, most: int = MOST) -> DataFrame:
    """(doc_id, cuts, last_page, long) of documents of several segments or, long, of one too large: a cut (page, at) a range of pages at most."""
    facts = lined.select(
        "doc_id", "page", F.coalesce(F.floor(F.col("page") / a_range), F.lit(FIRST)).alias("range"),
        F.aggregate("__lines", F.lit(0).cast("long"), lambda n, x: n + F.length(x) + 1).alias("chars"),
        F.when(F.col("page") >= a_range, cut_place(F.col("__lines"), rules)).alias("at"),
    )
    page = F.when(F.col("at").isNotNull(), F.col("page"))
    ranges = facts.groupBy("doc_id", "range").agg(
        F.sum("chars").alias("chars"), F.min(page).alias("cut_page"), F.min_by("at", page).alias("cut_at"), F.max("page").alias("last_page")
    )
    documents = ranges.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("range", "chars", "cut_page", "cut_at"))).alias("ranges"), F.max("last_page").alias("last_page")
    )
    start = F.struct(F.lit(0).cast("long").alias("chars"), F.lit(False).alias("long"))

    def step(acc: Column, r: Column) -> Column:
        """A segment may begin with its range, and ends within the range of the next cut."""
        sofar = acc["chars"] + r["chars"]
        return F.struct(F.when(r["cut_page"].isNotNull(), r["chars"]).otherwise(sofar).alias("chars"), (acc["long"] | (sofar > most)).alias("long"))

    found = documents.select(
        "doc_id", F.transform(F.filter("ranges", lambda r: r["cut_page"].isNotNull()), lambda r: F.struct(r["cut_page"].alias("page"), r["cut_at"].alias("at"))).alias("cuts"),
        "last_page", F.aggregate("ranges", start, step)["long"].alias("long"),
    )
    return found.where((F.size("cuts") > 0) | F.col("long"))


def segment_lines(lined: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """(doc_id, segment, page, at, line, next_page, last_page) of the documents that aren't long. how: left for all, inner for those of several segments.

    next_page is that of the next segment, last_page the document's, where there are several. `known`, some bytes for a range
    of pages of documents with several ranges, goes to all tasks: else texts would be dealt by document to meet it.
    """
    both = lined.join(F.broadcast(known), "doc_id", how).where(~F.coalesce("long", F.lit(False)))
    upto = F.coalesce(F.size(F.filter("cuts", lambda c: c["page"] <= F.col("page"))), F.lit(0))  # none of a page without a number
    upto = F.when(F.col("cuts").isNull(), 0).otherwise(upto)
    here = F.get(F.filter("cuts", lambda c: c["page"] == F.col("page")), F.lit(0))["at"]
    placed = both.withColumns({"upto": upto, "here": here}).select("*", F.posexplode("__lines").alias("at", "line"))
    segment = F.when(F.col("at") < F.col("here"), F.col("upto") - 1).otherwise(F.col("upto"))
    return placed.withColumn("segment", segment).select(
        "doc_id", "segment", "page", "at", "line", F.get("cuts", F.col("segment"))["page"].alias("next_page"), "last_page"
    )


def segment_chunks(lines: DataFrame, rules: Rules) -> DataFrame:
    """Chunks, split, of segment_lines(). Their ordinals, and the sections in their names, are numbered in the segment; n_sections: its sections."""
    whole = Window.partitionBy(*SEGMENT)
    order = whole.orderBy("page", "at")
    marked = lines.withColumn("is_title", rules.is_title(F.col("line"))).withColumns(
        {"section": F.sum(F.col("is_title").cast("long")).over(order), "last_page": F.coalesce("last_page", F.max("page").over(whole))}
    )
    packed = marked.groupBy(*SEGMENT, "section").agg(
        F.array_sort(F.collect_list(F.struct("page", "at", "line"))).alias("rows"), F.min("page").alias("page_start"),
        F.max("next_page").alias("next_page"), F.max("last_page").alias("last_page"), F.max("is_title").alias("titled"),
    )
    by_section = whole.orderBy("section")
    found = packed.select(
        *SEGMENT, F.row_number().over(by_section).cast("long").alias("ordinal"), "page_start",
        F.coalesce(F.lead("page_start").over(by_section), F.when(F.lead("section").over(by_section).isNull(), F.col("next_page")), "last_page").alias("page_end"),
        F.when(F.col("titled"), rules.title_of(F.get("rows", F.lit(0))["line"])).otherwise(rules.preamble).alias("section_title"),
        F.array_join("rows.line", "\n").alias("text"),
    )
    raw = C.described(found, rules, ("segment",))
    chunk = F.struct([c for c in C.CHUNK_COLUMNS if c != "doc_id"])
    facts = F.struct("ordinal", F.col("char_count").alias("size"), F.nullif(F.col("matched_category"), F.lit("")).alias("category"), chunk.alias("chunk"))
    listed = raw.groupBy(*SEGMENT).agg(F.array_sort(F.collect_list(facts)).alias("facts"))
    numbered = listed.select(*SEGMENT, "facts", C.group_list(F.col("facts"), rules).alias("groups"))
    pairs = F.arrays_zip(F.col("facts.chunk").alias("chunk"), F.col("groups").alias("group"))
    each = numbered.select(*SEGMENT, F.size("facts").cast("long").alias("n_sections"), F.explode(pairs).alias("x")).select(*SEGMENT, "n_sections", "x.group", "x.chunk.*")
    merged = C.reclassified(C.grouped(each, [*SEGMENT, "n_sections", "group"]), rules)
    parts = merged.select("*", F.posexplode(C.parts_of(F.col("text"), rules.large)).alias("part", "piece"))
    return parts.withColumn("number", F.row_number().over(whole.orderBy("ordinal", "part")).cast("long"))


def name(section: Column, part: Column) -> Column:
    return C.part_name(chunk_name(F.col("doc_id").cast("string"), section), part)


def edges(parts: DataFrame) -> DataFrame:
    """(doc_id, segment, sections_before, parts_before, chunk_before, chunk_behind) of segment_chunks()."""
    end = F.struct("ordinal", "part", "coverage_type", "matched_category")
    by_segment = Window.partitionBy("doc_id").orderBy("segment")
    before = by_segment.rowsBetween(Window.unboundedPreceding, -1)
    found = parts.groupBy(*SEGMENT).agg(
        F.max("n_sections").alias("n_sections"), F.count("*").alias("n_parts"), F.min_by(end, "number").alias("first"), F.max_by(end, "number").alias("last")
    ).withColumn("sections_before", F.coalesce(F.sum("n_sections").over(before), F.lit(0).cast("long")))
    return found.select(
        *SEGMENT, "sections_before", F.coalesce(F.sum("n_parts").over(before), F.lit(0).cast("long")).alias("parts_before"),
        F.lag(beside(F.col("last"), F.col("sections_before"))).over(by_segment).alias("chunk_before"),
        F.lead(beside(F.col("first"), F.col("sections_before"))).over(by_segment).alias("chunk_behind"),
    )


def beside(end: Column, sections_before: Column) -> Column:
    """A neighbour as a link sees it."""
    told = F.struct(name(end["ordinal"] + sections_before, end["part"]).alias("chunk_id"), end["coverage_type"].alias("coverage_type"), end["matched_category"].alias("matched_category"))
    return F.when(end.isNotNull(), told)


def by_segments(lined: DataFrame, rules: Rules, known: DataFrame | None) -> DataFrame:
    """chunks.chunk_pipeline() of the documents that aren't long; known: cuts(), or None where all documents are of one segment."""
    none = F.lit(None).cast("long")
    if known is None:
        lines = lined.select("doc_id", F.lit(0).alias("segment"), "page", F.posexplode("__lines").alias("at", "line")).withColumns({"next_page": none, "last_page": none})
    else:
        lines = segment_lines(lined, known, "left")
    end = F.struct("ordinal", "part", "coverage_type", "matched_category")
    order = Window.partitionBy(*SEGMENT).orderBy("number")
    parts = segment_chunks(lines, rules).withColumns({"last": F.lag(end).over(order), "next": F.lead(end).over(order)})
    if known is None:
        placed = parts.withColumns({"sections_before": F.lit(0).cast("long"), "parts_before": F.lit(0).cast("long")})
        last, following = (beside(F.col(c), F.col("sections_before")) for c in ("last", "next"))
    else:
        found = parts.join(edges(segment_chunks(segment_lines(lined, known, "inner"), rules)), SEGMENT, "left")
        placed = found.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("sections_before", "parts_before")})
        last = F.coalesce(beside(F.col("last"), F.col("sections_before")), "chunk_before")
        following = F.coalesce(beside(F.col("next"), F.col("sections_before")), "chunk_behind")
    both = placed.withColumns({"last": last, "next": following, "chunk_id": name(F.col("ordinal") + F.col("sections_before"), F.col("part"))})
    pair = lambda own, side, other: (F.col("coverage_type") == own) & (F.col(side)["coverage_type"] == other) & (F.col(side)["matched_category"] == F.col("matched_category"))
    linked = F.when(pair("included", "next", "excluded"), F.col("next")["chunk_id"]).when(pair("excluded", "last", "included"), F.col("last")["chunk_id"])
    return both.withColumns(
        {"related_chunk_id": linked, "text": F.col("piece"), "char_count": C.long_length(F.col("piece")), "ordinal": F.col("number") + F.col("parts_before")}
    ).select(C.CHUNK_COLUMNS)


def chunk_pipeline(pages: DataFrame, rules: Rules, pages_a_range: int = PAGES, chunks_a_range: int = CHUNKS, most: int = MOST) -> DataFrame:
    """chunks.chunk_pipeline(), for documents larger than a task. Where documents are cut is found at once."""
    lined = C.content_lines(pages.where("doc_id is not null"), rules).select("doc_id", F.col("page").cast("long").alias("page"), "__lines")
    found = cuts(lined, rules, pages_a_range, most).toArrow()
    if not found.num_rows:
        return by_segments(lined, rules, None)
    chunks = by_segments(lined, rules, pages.sparkSession.createDataFrame(found))
    long = found.filter(found["long"])["doc_id"].to_pylist()  # as values: a join would stand in each of the many branches of the sums
    if not long:
        return chunks
    return chunks.union(by_sums(pages.where(F.col("doc_id").isin(long)), rules, pages_a_range, chunks_a_range))
