"""Pieces of the DuckDB statements that queries are checked against."""

from __future__ import annotations

from ..functions.rules import CORPUS, Rules
from ..functions.text import CONTROL, EDGES, NL, PAGE_NUMBER, WS

def strip(x: str) -> str:
    return f"regexp_replace({x}, '{EDGES}', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def no_space(x: str) -> str:
    return f"regexp_replace({x}, '{WS}', '', 'g')"


def form(x: str) -> str:
    return f"lower({no_space(x)})"


def sanitise(x: str) -> str:
    return f"regexp_replace({x}, '{CONTROL}', '', 'g')"


def lines_of(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{NL}'), lambda x: {strip('x')}), lambda x: x <> '')"


def is_page_number(x: str) -> str:
    return f"regexp_matches({strip(x)}, '{PAGE_NUMBER}')"


def contains_any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{''.join(w.split()).lower()}')" for w in words) + ")"


def coverage(title: str, text: str, rules: Rules = CORPUS) -> str:
    seen = form(f"({title} || chr(10) || substr({text}, 1, {rules.coverage_chars}))")
    return (
        f"CASE WHEN {contains_any(seen, rules.excluded)} THEN 'excluded' WHEN {contains_any(seen, rules.procedure)} THEN 'procedure' "
        f"WHEN {contains_any(seen, rules.definition)} THEN 'definition' ELSE 'included' END"
    )


def is_title(line: str, rules: Rules) -> str:
    """Of a stripped line."""
    noise = " OR ".join(f"contains({line}, '{w}')" for w in rules.noise_words)
    fits = f"length({line}) BETWEEN {rules.title_chars[0]} AND {rules.title_chars[1]} AND length({line}) - length(replace({line}, ',', '')) <= {rules.most_commas}"
    return f"({fits} AND NOT ({noise}) AND (" + " OR ".join(f"regexp_matches({line}, '{p}')" for p, _ in rules.title_patterns) + "))"


def title_of(line: str, rules: Rules) -> str:
    """Of a stripped line."""
    return "CASE " + " ".join(f"WHEN regexp_matches({line}, '{p}') THEN {strip(f"regexp_extract({line}, '{p}', {g})")}" for p, g in rules.title_patterns) + f" ELSE {line} END"


def keyword_field(seen: str, field: str) -> str:
    """CASE over the keywords in their order."""
    quoted = lambda v: "NULL" if v is None else f"'{v}'"
    return "CASE " + " ".join(f"WHEN contains({seen}, '{k.form}') THEN {quoted(getattr(k, field))}" for k in CORPUS.keywords) + " END"


IS_TITLE = f"(length(line) BETWEEN {CORPUS.title_chars[0]} AND {CORPUS.title_chars[1]} AND length(line) - length(replace(line, ',', '')) <= {CORPUS.most_commas})"

DOC_LINES = f"""
    doc_lines AS (SELECT doc_id, {lines_of("text")} AS ls FROM documents),
    paged AS (
        SELECT doc_id, CAST((i - 1) // 20 + 1 AS BIGINT) AS page, i AS pos, ls[i] AS line
        FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM doc_lines))"""

CONTENT = f"""{DOC_LINES},
    content AS (
        SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS line_no, line
        FROM paged SEMI JOIN (SELECT doc_id, page FROM paged GROUP BY ALL
             HAVING count(*) >= {CORPUS.toc_lines} AND avg(length(line)) >= {CORPUS.toc_chars}) USING (doc_id, page))"""

SECTIONS = f"""{CONTENT},
    marked AS (
        SELECT *, {IS_TITLE} AS is_title, sum(CASE WHEN {IS_TITLE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section,
               max(page) OVER (PARTITION BY doc_id) AS last_page FROM content),
    packed AS (
        SELECT doc_id, section, string_agg(line, chr(10) ORDER BY line_no) AS text, min(page) AS page_start, max(last_page) AS last_page,
               CASE WHEN bool_or(is_title) THEN arg_min(line, line_no) ELSE '{CORPUS.preamble}' END AS section_title
        FROM marked GROUP BY doc_id, section),
    sections AS (
        SELECT doc_id, CAST(row_number() OVER w AS BIGINT) AS ordinal, page_start, coalesce(lead(page_start) OVER w, last_page) AS page_end,
               section_title, text
        FROM packed WINDOW w AS (PARTITION BY doc_id ORDER BY section))"""

_SEEN = form("(section_title || chr(10) || text)")
RAW = f"""{SECTIONS},
    seen AS (SELECT *, {_SEEN} AS seen FROM sections),
    raw AS (
        SELECT printf('%d_%04d', doc_id, ordinal) AS chunk_id, doc_id, ordinal, page_start, page_end, section_title,
               {coverage("section_title", "text")} AS coverage_type, text, CAST(length(text) AS BIGINT) AS char_count,
               {keyword_field("seen", "primary")} AS matched_category, {keyword_field("seen", "secondary")} AS secondary_category,
               {keyword_field("seen", "keyword")} AS matched_keyword, CAST(NULL AS VARCHAR) AS related_chunk_id
        FROM seen)"""

#: The fold runs as recursion over a document's chunks.
MERGED = f"""{RAW},
    steps AS (
        SELECT doc_id, ordinal, 1 AS grp, char_count AS size, matched_category AS category FROM raw WHERE ordinal = 1
        UNION ALL
        SELECT r.doc_id, r.ordinal,
               CASE WHEN s.size < {CORPUS.small} AND coalesce(s.category = r.matched_category, true) THEN s.grp ELSE s.grp + 1 END,
               CASE WHEN s.size < {CORPUS.small} AND coalesce(s.category = r.matched_category, true) THEN s.size + 1 + r.char_count ELSE r.char_count END,
               CASE WHEN s.size < {CORPUS.small} AND coalesce(s.category = r.matched_category, true) THEN coalesce(s.category, r.matched_category) ELSE r.matched_category END
        FROM steps s JOIN raw r ON r.doc_id = s.doc_id AND r.ordinal = s.ordinal + 1),
    merged AS (
        SELECT arg_min(chunk_id, ordinal) AS chunk_id, doc_id, min(ordinal) AS ordinal, arg_min(page_start, ordinal) AS page_start,
               arg_max(page_end, ordinal) AS page_end, arg_min(section_title, ordinal) AS section_title,
               arg_min(coverage_type, ordinal) AS coverage_type, string_agg(text, chr(10) ORDER BY ordinal) AS text,
               CAST(length(string_agg(text, chr(10) ORDER BY ordinal)) AS BIGINT) AS char_count,
               arg_min(matched_category, ordinal) FILTER (matched_category IS NOT NULL) AS matched_category,
               arg_min(secondary_category, ordinal) FILTER (secondary_category IS NOT NULL) AS secondary_category,
               arg_min(matched_keyword, ordinal) FILTER (matched_keyword IS NOT NULL) AS matched_keyword,
               CAST(NULL AS VARCHAR) AS related_chunk_id
        FROM raw JOIN steps USING (doc_id, ordinal) GROUP BY doc_id, grp)"""

RETYPED = f"""{MERGED},
    retyped AS (SELECT * REPLACE ({coverage("section_title", "text")} AS coverage_type) FROM merged)"""


def split_ctes(source: str) -> str:
    """CTEs up to `split`, over a relation of chunks."""
    return f"""
    big AS (SELECT chunk_id, string_split(text, chr(10)) AS ls FROM {source} WHERE char_count > {CORPUS.large}),
    big_lines AS (SELECT chunk_id, i, ls[i] AS line FROM (SELECT chunk_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM big)),
    packing AS (
        SELECT chunk_id, i, 1 AS part, length(line) + 1 AS size FROM big_lines WHERE i = 1
        UNION ALL
        SELECT l.chunk_id, l.i, CASE WHEN p.size > 0 AND p.size + length(l.line) + 1 > {CORPUS.large} THEN p.part + 1 ELSE p.part END,
               CASE WHEN p.size > 0 AND p.size + length(l.line) + 1 > {CORPUS.large} THEN 0 ELSE p.size END + length(l.line) + 1
        FROM packing p JOIN big_lines l ON l.chunk_id = p.chunk_id AND l.i = p.i + 1),
    parts AS (SELECT chunk_id, part, string_agg(line, chr(10) ORDER BY i) AS text FROM packing JOIN big_lines USING (chunk_id, i) GROUP BY ALL),
    cuts AS (
        SELECT chunk_id, part, k, substr(text, k * {CORPUS.large} + 1, {CORPUS.large}) AS piece
        FROM (SELECT chunk_id, part, text, unnest(range(0, (length(text) - 1) // {CORPUS.large} + 1)) AS k FROM parts)),
    pieces AS (
        SELECT chunk_id, piece, row_number() OVER (PARTITION BY chunk_id ORDER BY part, k) AS n FROM cuts
        UNION ALL SELECT chunk_id, text, 1 FROM {source} WHERE char_count <= {CORPUS.large}),
    split AS (
        SELECT CASE WHEN n = 1 THEN c.chunk_id ELSE c.chunk_id || '_' || n END AS chunk_id, doc_id,
               CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, n) AS BIGINT) AS ordinal, page_start, page_end, section_title,
               coverage_type, piece AS text, CAST(length(piece) AS BIGINT) AS char_count, matched_category, secondary_category,
               matched_keyword, related_chunk_id
        FROM {source} c JOIN pieces USING (chunk_id))"""


def linked(source: str) -> str:
    return f"""
        SELECT * REPLACE (CASE
            WHEN coverage_type = 'included' AND lead(coverage_type) OVER w = 'excluded' AND lead(matched_category) OVER w = matched_category THEN lead(chunk_id) OVER w
            WHEN coverage_type = 'excluded' AND lag(coverage_type) OVER w = 'included' AND lag(matched_category) OVER w = matched_category THEN lag(chunk_id) OVER w
            END AS related_chunk_id)
        FROM {source} WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)"""


OBJECTS = """
    objects AS (
        SELECT l_orderkey AS table_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS object_id,
               CASE WHEN l_linenumber % 2 = 0 THEN 'table row' ELSE 'table column' END AS label, 1 - l_discount * 6 AS score,
               (l_partkey * 7 % 500) * 1.0::DOUBLE AS xmin, ((l_suppkey * 13 + l_linenumber * 61) % 700) * 1.0::DOUBLE AS ymin,
               (l_partkey * 7 % 500) * 1.0::DOUBLE + l_quantity * 3 AS xmax, ((l_suppkey * 13 + l_linenumber * 61) % 700) * 1.0::DOUBLE + l_quantity * 2 AS ymax
        FROM lineitem)"""


def merged_boxes(name: str, source: str, axis: str) -> str:
    other = "y" if axis == "x" else "x"
    return f"""
    {name}_new AS (
        SELECT *, CASE WHEN {axis}min <= max({axis}max) OVER (PARTITION BY table_id ORDER BY {axis}min, object_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                  THEN 0 ELSE 1 END AS opens FROM {source}),
    {name}_no AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY table_id ORDER BY {axis}min, object_id) AS BIGINT) AS group_no FROM {name}_new),
    {name} AS (
        SELECT table_id, group_no, arg_min(label, ({axis}min, object_id)) AS label, max(score) AS score, min({axis}min) AS {axis}min,
               max({axis}max) AS {axis}max, min({other}min) AS {other}min, max({other}max) AS {other}max
        FROM {name}_no GROUP BY table_id, group_no)"""


def filled_boxes(name: str, source: str, axis: str, low: str, high: str) -> str:
    return f"""
    {name} AS (
        SELECT * REPLACE (
            coalesce((lag({axis}max) OVER w + {axis}min) / 2, {low}) AS {axis}min,
            coalesce(({axis}max + lead({axis}min) OVER w) / 2, {high}) AS {axis}max)
        FROM {source} WINDOW w AS (PARTITION BY table_id ORDER BY group_no))"""


BLOCKS = """
    blocks AS (
        SELECT l_orderkey % 2000 AS doc_id, l_orderkey // 2000 AS page, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS block_idx,
               40.0::DOUBLE + (l_partkey % 3) * 180.0::DOUBLE AS x0, ((l_suppkey * 37 + l_linenumber * 13) % 90) * 9.0::DOUBLE AS y0,
               40.0::DOUBLE + (l_partkey % 3) * 180.0::DOUBLE + l_partkey % 170 AS x1,
               ((l_suppkey * 37 + l_linenumber * 13) % 90) * 9.0::DOUBLE + 5 + l_partkey % 9 AS y1,
               CASE WHEN l_partkey % 5 = 0 THEN 'Terms  of' || chr(9) || 'service' WHEN l_partkey % 7 = 0 THEN CAST(l_linenumber AS VARCHAR)
                    ELSE ' part' || chr(1) || ' ' || l_partkey || ' ' || l_returnflag || chr(10) || l_linestatus || ' ' END AS raw_text,
               CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END AS block_type, 595.0::DOUBLE AS page_w, 842.0::DOUBLE AS page_h
        FROM lineitem),
    clean AS (SELECT * EXCLUDE (raw_text), """ + sanitise("raw_text") + """ AS text FROM blocks)"""

REPEATED = f"""
    zoned AS (
        SELECT doc_id, page, {collapse("text")} AS norm, CASE WHEN y1 < page_h * 0.08 THEN 'header' WHEN y0 > page_h * 0.92 THEN 'footer' END AS zone
        FROM clean WHERE length({strip("text")}) >= 2),
    page_counts AS (SELECT doc_id, count(DISTINCT page) AS n_pages FROM clean GROUP BY doc_id),
    repeated AS (
        SELECT DISTINCT doc_id, norm FROM (SELECT doc_id, zone, norm, count(*) AS n FROM zoned WHERE zone IS NOT NULL GROUP BY ALL)
        JOIN page_counts USING (doc_id) WHERE n >= 0.4 * n_pages)"""


def row_numbers(name: str, source: str) -> str:
    return f"""
    {name}_starts AS (
        SELECT *, max(y1) OVER w AS reach FROM {source}
        WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {name} AS (
        SELECT * EXCLUDE (reach), CAST(sum(CASE WHEN coalesce(reach < 0 OR (y0 + y1) / 2 > reach, true) THEN 1 ELSE 0 END)
               OVER (PARTITION BY doc_id, page ORDER BY y0, block_idx) AS BIGINT) AS row_no FROM {name}_starts)"""


ROW_TEXT = f"""CASE WHEN len(b) = 1 THEN b[1].text
        WHEN len(b) = 2 AND b[1].x1 <= w * 0.45 AND b[2].x0 > w * 0.45 * 0.7 AND b[1].text <> '' AND b[2].text <> ''
            THEN {collapse("b[1].text")} || chr(10) || b[2].text
        ELSE array_to_string(list_transform(list_filter(b, lambda x: x.text <> ''), lambda x: {collapse("x.text")}), ' | ') END"""


def formatted_rows(name: str, source: str) -> str:
    return f"""
    {name}_packed AS (
        SELECT doc_id, page, row_no, list({{'x1': x1, 'x0': x0, 'text': {strip("text")}}} ORDER BY x0, y0, block_idx) AS b, max(page_w) AS w
        FROM {source} GROUP BY ALL),
    {name} AS (SELECT doc_id, page, row_no, {ROW_TEXT} AS row_text FROM {name}_packed)"""
