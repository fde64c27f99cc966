"""Named queries over the driver's tables, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import CORPUS, KOREAN_POLICY
from ..operators import boxes, chunks, ingest, keywords, large_documents, layout, reports, retrieval, vectors
from ..sources.files import joined, with_local_scope
from . import relations as R
from . import sql as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query by its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "documents")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.flat_lines(R.pages(spark, sf_dir))


# Strings


@query(f"""SELECT doc_id, {S.sanitise("('a' || chr(1) || text || chr(7) || chr(9) || chr(31))")} AS clean FROM documents""")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit("a\x01"), F.col("text"), F.lit("\x07\t\x1f"))
    return docs(spark, sf_dir).select("doc_id", T.sanitised(dirty).alias("clean"))


@query(f"SELECT doc_id, {S.form('text')} AS form FROM documents")
def normalize_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.match_form(F.col("text")).alias("form"))


@query(f"SELECT doc_id, {S.collapse('text')} AS flat, {S.no_space('text')} AS bare FROM documents")
def whitespace_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.collapsed(F.col("text")).alias("flat"), T.compare_form(F.col("text")).alias("bare"))


@query("""
    WITH t AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS title FROM documents)
    SELECT doc_id, CASE WHEN title = '' OR contains(text, title) THEN text ELSE title || chr(10) || text END AS own,
           CASE WHEN source = '' OR contains(text, source) THEN text ELSE source || chr(10) || text END AS named
    FROM t JOIN (SELECT doc_id, source FROM documents) USING (doc_id)""")
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.get(F.split("text", "\n"), F.lit(0))
    return docs(spark, sf_dir).select("doc_id", T.embed_text(title, F.col("text")).alias("own"), T.embed_text(F.col("source"), F.col("text")).alias("named"))


@query("""
    SELECT doc_id, printf('%s_%04d', source, doc_id) AS chunk_id,
           CASE WHEN doc_id % 3 = 0 THEN doc_id || 'p' ELSE doc_id || '~' || (doc_id + doc_id % 3) || 'p' END AS pages,
           replace(substr(text, 1, 200), chr(10), ' ') AS preview,
           CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS quote,
           format('{:,}', n_chars * 1000) AS amount
    FROM documents""")
def labels_and_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("doc_id")
    return docs(spark, sf_dir).select(
        "doc_id", T.chunk_name(F.col("source"), page).alias("chunk_id"), T.page_label(page, page + page % 3).alias("pages"),
        T.preview(F.col("text")).alias("preview"), T.quote(F.col("text")).alias("quote"), F.format_number(F.col("n_chars") * 1000, 0).alias("amount"),
    )


# Layout


@query(f"""
    WITH {S.DOC_LINES}, c AS (SELECT doc_id, page, unnest([line, CAST(pos AS VARCHAR), '- ' || pos || ' -', pos || '. ' || line]) AS line FROM paged)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({S.is_page_number("line")}) AS n_numbers FROM c GROUP BY doc_id""")
def page_number_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line_no").cast("string")
    variants = F.explode(F.array("line", n, F.concat(F.lit("- "), n, F.lit(" -")), F.concat(n, F.lit(". "), "line"))).alias("line")
    return (
        lines(spark, sf_dir).select("doc_id", variants).groupBy("doc_id")
        .agg(F.count("*").alias("n_lines"), F.count_if(T.is_page_number(F.col("line"))).alias("n_numbers"))
    )


@query(f"WITH {S.BLOCKS}, {S.REPEATED} SELECT doc_id, norm FROM repeated")
def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.repeated_texts(layout.clean_blocks(R.blocks(spark, sf_dir)))


@query(f"WITH {S.BLOCKS}, {S.row_numbers('numbered', '(SELECT * FROM clean WHERE block_type = 0)')} SELECT doc_id, page, block_idx, row_no FROM numbered")
def row_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = layout.clean_blocks(R.blocks(spark, sf_dir)).where("block_type = 0")
    return layout.group_rows(blocks).select("doc_id", "page", "block_idx", "row_no")


@query(f"WITH {S.BLOCKS}, {S.row_numbers('numbered', '(SELECT * FROM clean WHERE block_type = 0)')}, {S.formatted_rows('formatted', 'numbered')} SELECT * FROM formatted")
def row_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = layout.clean_blocks(R.blocks(spark, sf_dir)).where("block_type = 0")
    return layout.format_rows(layout.group_rows(blocks))


@query(f"""
    WITH {S.BLOCKS}, {S.REPEATED}, {S.row_numbers('numbered', '(SELECT * FROM clean WHERE block_type = 0)')},
    kept AS (
        SELECT * FROM (SELECT *, {S.collapse("text")} AS norm FROM numbered) ANTI JOIN repeated USING (doc_id, norm)
        WHERE length({S.strip("text")}) >= 2 AND NOT {S.is_page_number("text")}),
    {S.formatted_rows('formatted', 'kept')},
    lined AS (SELECT doc_id, page, row_no, array_to_string(list_transform({S.lines_of("row_text")}, lambda y: {S.collapse("y")}), chr(10)) AS row_text FROM formatted)
    SELECT doc_id, page, coalesce(text, '') AS text FROM (SELECT DISTINCT doc_id, page FROM clean)
    LEFT JOIN (SELECT doc_id, page, string_agg(row_text, chr(10) ORDER BY row_no) AS text FROM lined WHERE row_text <> '' GROUP BY ALL) USING (doc_id, page)""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_texts(R.blocks(spark, sf_dir))


# Sections and chunks


@query(f"WITH {S.DOC_LINES} SELECT doc_id, page, CAST(pos AS BIGINT) AS line_no, line FROM paged")
def line_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir)


@query(f"""
    WITH {S.DOC_LINES} SELECT doc_id, page, string_agg(line, chr(10) ORDER BY pos) AS text FROM paged GROUP BY ALL
    HAVING count(*) >= {CORPUS.toc_lines} AND avg(length(line)) >= {CORPUS.toc_chars}""")
def toc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.content_pages(R.pages(spark, sf_dir), CORPUS)


@query(f"WITH {S.DOC_LINES} SELECT doc_id, CAST(pos AS BIGINT) AS line_no, line AS title FROM paged WHERE {S.IS_TITLE}")
def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines(spark, sf_dir).where(CORPUS.is_title(F.col("line")))
    return found.select("doc_id", "line_no", CORPUS.title_of(F.col("line")).alias("title"))


@query(f"WITH {S.SECTIONS} SELECT * FROM sections")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.sections(chunks.flat_lines(chunks.content_pages(R.pages(spark, sf_dir), CORPUS)), CORPUS)


_KEYWORDS = f"""
    WITH d AS (SELECT doc_id, {S.form("(source || chr(10) || text)")} AS seen FROM documents)
    SELECT doc_id, {S.keyword_field("seen", "primary")} AS matched_category, {S.keyword_field("seen", "secondary")} AS secondary_category,
           {S.keyword_field("seen", "keyword")} AS matched_keyword FROM d"""


@query(_KEYWORDS)
def keyword_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", CORPUS.category(F.col("source"), F.col("text")).alias("c")).select("doc_id", "c.*")


@query(_KEYWORDS)
def keyword_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword_category by joins on pieces of keywords, as large tables of keywords need it."""
    texts = docs(spark, sf_dir).select("doc_id", F.col("source").alias("title"), "text")
    return keywords.keyword_matches(texts, keywords.keyword_table(spark, CORPUS.keywords))


_POLICY_LINES = f"""{S.DOC_LINES},
    made AS (
        SELECT doc_id, CAST(pos AS BIGINT) AS line_no, {S.strip("CASE pos % " + str(len(R.POLICY_FORMS)) + " " + " ".join(f"WHEN {i} THEN '{head}' || substr(line, 1, {n}) || '{tail}'" for i, (head, n, tail) in enumerate(R.POLICY_FORMS)) + " END")} AS line FROM paged),
    titled AS (SELECT *, {S.is_title("line", KOREAN_POLICY)} AS is_title FROM made),
    named AS (SELECT *, CASE WHEN is_title THEN {S.title_of("line", KOREAN_POLICY)} ELSE '' END AS title FROM titled)"""


@query(f"WITH {_POLICY_LINES} SELECT doc_id, line_no, is_title, title, {S.coverage('title', 'line', KOREAN_POLICY)} AS coverage_type FROM named")
def policy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and coverage types of Korean policies, on the documents' lines worded as theirs."""
    line, found = F.col("line"), KOREAN_POLICY.is_title(F.col("line"))
    made = R.policy_lines(lines(spark, sf_dir)).withColumn("is_title", found)
    named = made.withColumn("title", F.when(F.col("is_title"), KOREAN_POLICY.title_of(line)).otherwise(""))
    return named.select("doc_id", "line_no", "is_title", "title", KOREAN_POLICY.coverage_type(F.col("title"), line).alias("coverage_type"))


@query(f"SELECT doc_id, {S.coverage('source', 'text')} AS coverage_type FROM documents")
def coverage_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", CORPUS.coverage_type(F.col("source"), F.col("text")).alias("coverage_type"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.raw_chunks(R.pages(spark, sf_dir), CORPUS)


@query(f"WITH {S.RAW} SELECT * FROM raw")
def raw_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir)


@query(f"WITH RECURSIVE {S.MERGED} SELECT * FROM merged")
def merge_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.merge_small(raw(spark, sf_dir), CORPUS)


@query(f"WITH RECURSIVE {S.RETYPED} SELECT chunk_id, coverage_type FROM retyped")
def reclassify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.reclassified(chunks.merge_small(raw(spark, sf_dir), CORPUS), CORPUS).select("chunk_id", "coverage_type")


@query(f"WITH RECURSIVE {S.RAW}, {S.split_ctes('raw')} SELECT * FROM split")
def split_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split_large(raw(spark, sf_dir), CORPUS)


@query(f"WITH {S.RAW} {S.linked('raw')}")
def link_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.link_pairs(raw(spark, sf_dir))


_PIPELINE = f"{S.RETYPED}, {S.split_ctes('retyped')}"


@query(f"WITH RECURSIVE {_PIPELINE} {S.linked('split')}")
def chunk_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_pipeline(R.pages(spark, sf_dir), CORPUS)


@query(ORACLES["chunk_pipeline"])
def large_chunk_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_pipeline by ranges of pages and chunks, as documents larger than a task need it."""
    return large_documents.chunk_pipeline(R.pages(spark, sf_dir), CORPUS)


# Reports


@query(f"""
    WITH {S.RAW}, firsts AS (SELECT *, row_number() OVER (PARTITION BY matched_category ORDER BY doc_id, ordinal) AS k FROM raw WHERE matched_category IS NOT NULL)
    SELECT matched_category, count(*) AS n, min(doc_id) FILTER (k = 1) AS first_doc, min(ordinal) FILTER (k = 1) AS first_ordinal
    FROM firsts GROUP BY matched_category""")
def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.category_histogram(raw(spark, sf_dir))


@query(f"""
    WITH {S.RAW} SELECT count(*) AS total, count(matched_category) AS matched, count(*) - count(matched_category) AS unmatched,
           count(matched_category) / nullif(count(*), 0) AS matched_share FROM raw""")
def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chunk_summary(raw(spark, sf_dir))


@query(f"""
    WITH {S.RAW}, links AS ({S.linked('raw')})
    SELECT doc_id, count(*) AS n_chunks, count(matched_category) AS n_matched, count(*) FILTER (char_count < 100) AS n_tiny,
           count(related_chunk_id) AS n_linked, {", ".join(f"count(*) FILTER (coverage_type = '{k}') AS n_{k}" for k in reports.COVERAGE_TYPES)},
           coalesce(string_agg(DISTINCT matched_category, ',' ORDER BY matched_category), '') AS categories,
           count(matched_category) / count(*) AS matched_share
    FROM links GROUP BY doc_id""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chunk_stats(chunks.link_pairs(raw(spark, sf_dir)))


@query(f"""
    WITH {S.RAW}, shown AS (SELECT *, row_number() OVER (PARTITION BY matched_category IS NULL ORDER BY doc_id, ordinal) AS k FROM raw)
    SELECT chunk_id, section_title, matched_category, replace(substr(text, 1, 200), chr(10), ' ') AS preview
    FROM shown WHERE k <= CASE WHEN matched_category IS NULL THEN 10 ELSE 20 END""")
def chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chunk_previews(raw(spark, sf_dir))


@query(f"""
    WITH {S.DOC_LINES}, p AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY pos) AS text FROM paged GROUP BY ALL)
    SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS total_chars, count(*) FILTER (length(text) > 0) AS n_pages FROM p GROUP BY doc_id""")
def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.page_stats(R.pages(spark, sf_dir))


@query(f"WITH {S.RAW} SELECT doc_id, section_title AS title, coverage_type AS coverage_status, CAST(NULL AS VARCHAR) AS limit_amount, chunk_id AS source_chunk_ids FROM raw WHERE matched_category <> ''")
def coverage_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.coverage_items(raw(spark, sf_dir))
    return found.withColumns({"limit_amount": F.col("limit_amount").cast("string"), "source_chunk_ids": F.array_join("source_chunk_ids", ",")})


# Vectors and retrieval


def _cosine(which: str, on: str) -> str:
    return f"""
    q AS (SELECT vec_id AS query_id, embedding AS qv, label AS scope FROM embeddings WHERE {which}),
    scored AS (
        SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score
        FROM q JOIN embeddings e ON {on}),
    hits AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS BIGINT) AS rank, id, score FROM scored
             QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 8)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("scope"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries: vectors whose id is divisible by 100."""
    return corpus(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), "scope")


def rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


@query(f"WITH {_cosine(which='vec_id % 100 = 0', on='true')} SELECT query_id, rank, id, round(score, 6) AS score FROM hits")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.cosine_top_k(asked(spark, sf_dir), corpus(spark, sf_dir)))


@query(f"WITH {_cosine(which='vec_id % 100 = 0', on='e.label = q.scope')} SELECT query_id, rank, id, round(score, 6) AS score FROM hits")
def cosine_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.cosine_top_k(asked(spark, sf_dir), corpus(spark, sf_dir), scope="scope"))


@query("""
    WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm, embedding FROM embeddings)
    SELECT vec_id, round(norm, 6) AS norm, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / norm)), 5) AS total FROM n""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "embeddings").select("vec_id", vectors.norm(F.col("embedding")).alias("norm"), vectors.unit(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.round("norm", 6).alias("norm"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def hits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top hits with invented chunk columns: every vector is a chunk, related to the vector seven below it."""
    found = vectors.cosine_top_k(asked(spark, sf_dir), corpus(spark, sf_dir))
    return found.join(vector_chunks(spark, sf_dir), "id").select("query_id", "rank", *CHUNK_FIELDS, F.round("score", 6).alias("score"))


CHUNK_FIELDS = ["chunk_id", "document_id", "page_start", "page_end", "section_title", "coverage_type", "text", "related_chunk_id"]


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    texts = docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "text")
    kinds = F.array(*map(F.lit, ["included", "excluded", "procedure", "other"]))
    return (
        R.table(spark, sf_dir, "embeddings").select("vec_id", "label").join(texts, "vec_id", "left").select(
            i.alias("id"), F.concat(F.lit("c"), i.cast("string")).alias("chunk_id"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("document_id"),
            i.alias("page_start"), (i + i % 2).alias("page_end"), F.concat(F.lit("title "), i.cast("string")).alias("section_title"),
            F.get(kinds, i % 4).alias("coverage_type"), F.coalesce("text", F.lit("")).alias("text"),
            F.when((i % 3 == 0) & (i >= 7), F.concat(F.lit("c"), (i - 7).cast("string"))).alias("related_chunk_id"),
        )
    )


_CHUNKS = """
    chunks AS (
        SELECT vec_id AS id, 'c' || vec_id AS chunk_id, 'd' || label AS document_id, vec_id AS page_start, vec_id + vec_id % 2 AS page_end,
               'title ' || vec_id AS section_title, ['included', 'excluded', 'procedure', 'other'][vec_id % 4 + 1] AS coverage_type,
               coalesce(text, '') AS text, CASE WHEN vec_id % 3 = 0 AND vec_id >= 7 THEN 'c' || (vec_id - 7) END AS related_chunk_id
        FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"""
_RELATED = f"""{_cosine(which="vec_id % 100 = 0", on="true")}, {_CHUNKS},
    found AS (SELECT query_id, rank, {", ".join(CHUNK_FIELDS)}, round(score, 6) AS score FROM hits JOIN chunks USING (id)),
    wanted AS (
        SELECT query_id, related_chunk_id AS chunk_id, min(rank) AS first FROM found WHERE related_chunk_id IS NOT NULL GROUP BY ALL),
    added AS (
        SELECT query_id, (SELECT max(rank) FROM found f WHERE f.query_id = w.query_id) + row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank,
               {", ".join("c." + f for f in CHUNK_FIELDS)}, 0.0::DOUBLE AS score
        FROM wanted w JOIN chunks c USING (chunk_id) WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM found)),
    expanded AS (SELECT * FROM found UNION ALL SELECT * FROM added)"""


@query(f"WITH {_RELATED} SELECT * FROM expanded")
def attach_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.with_related(hits_of(spark, sf_dir), vector_chunks(spark, sf_dir).drop("id"))


@query(f"""
    WITH {_CHUNKS}, ids AS (SELECT vec_id AS query_id, unnest(['c' || vec_id * 2, 'missing', 'c0', 'c' || vec_id]) AS chunk_id, unnest([0, 1, 2, 3]) AS pos FROM embeddings)
    SELECT query_id, pos, chunk_id, section_title, 0.0::DOUBLE AS score FROM ids JOIN chunks USING (chunk_id)""")
def get_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    i = F.col("vec_id")
    ids = R.table(spark, sf_dir, "embeddings").select(i.alias("query_id"), F.array(name(i * 2), F.lit("missing"), F.lit("c0"), name(i)).alias("ids"))
    return retrieval.by_ids(ids, vector_chunks(spark, sf_dir)).select("query_id", "pos", "chunk_id", "section_title", "score")


@query(f"WITH {_RELATED} SELECT query_id, rank, chunk_id, document_id, page_start AS page, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS quote FROM expanded")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.sources(attach_related(spark, sf_dir))


_LABELLED = "coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in retrieval.COVERAGE_LABELS.items()) + "}[coverage_type], coverage_type)"
_EVIDENCE = f"""
    numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM expanded),
    evidence AS (
        SELECT query_id, string_agg('[{retrieval.EVIDENCE} ' || i || '] [' || {_LABELLED} || '] ' || section_title || ' ('
               || CASE WHEN page_start = page_end THEN page_start || 'p' ELSE page_start || '~' || page_end || 'p' END || ')' || chr(10) || text,
               chr(10) || chr(10) ORDER BY rank) AS evidence
        FROM numbered GROUP BY query_id)"""


@query(f"WITH {_RELATED}, {_EVIDENCE} SELECT * FROM evidence")
def evidence_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.evidence(attach_related(spark, sf_dir))


_HISTORY = f"""
    history AS (
        SELECT conv_id, '{retrieval.HISTORY}' || chr(10) || string_agg(CASE WHEN role = 'user' THEN '{retrieval.USER}' ELSE '{retrieval.ASSISTANT}' END
               || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history
        FROM conversations GROUP BY conv_id)"""


@query(f"WITH {_HISTORY} SELECT * FROM history")
def history_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.history_blocks(R.table(spark, sf_dir, "conversations"))


_CONTRACT = f"""
    contracts AS (
        SELECT o_custkey, '{retrieval.CONTRACT}' || chr(10) || string_agg('- ' || o_orderpriority || ': ' ||
               CASE WHEN o_orderstatus = 'O' THEN '{retrieval.SUBSCRIBED}' ELSE '{retrieval.NOT_SUBSCRIBED}' END ||
               CASE WHEN o_orderkey % 5 <> 0 THEN ' / {retrieval.LIMIT} ' || format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)) || '{retrieval.WON}' ELSE '' END,
               chr(10) ORDER BY o_orderkey) AS contract
        FROM orders GROUP BY o_custkey)"""


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(
        "o_orderkey", F.col("o_orderpriority").alias("name"), (F.col("o_orderstatus") == "O").alias("subscribed"),
        F.when(F.col("o_orderkey") % 5 != 0, F.floor("o_totalprice")).alias("limitAmount"),
    )
    held = R.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("coverages"))
    return held.select("o_custkey", retrieval.contract_block(F.col("coverages")).alias("contract"))


@query(f"WITH {_CONTRACT} SELECT * FROM contracts")
def contract_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts(spark, sf_dir)


@query(f"""
    WITH {_RELATED}, {_EVIDENCE}, {_HISTORY}, {_CONTRACT}
    SELECT q.query_id, concat_ws(chr(10) || chr(10), contract, history, '{retrieval.EVIDENCE_HEAD}' || chr(10) || coalesce(evidence, ''),
           '{retrieval.QUESTION_HEAD}' || chr(10) || 'vector ' || q.query_id) AS message
    FROM q LEFT JOIN evidence e ON e.query_id = q.query_id LEFT JOIN history ON conv_id = q.query_id LEFT JOIN contracts ON o_custkey = q.query_id""")
def user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = asked(spark, sf_dir).select("query_id").join(evidence_prompt(spark, sf_dir), "query_id", "left")
    told = history_prompt(spark, sf_dir).withColumnRenamed("conv_id", "query_id")
    held = contracts(spark, sf_dir).withColumnRenamed("o_custkey", "query_id")
    question = F.concat(F.lit("vector "), F.col("query_id").cast("string"))
    message = retrieval.user_message(F.col("contract"), F.col("history"), F.col("evidence"), question)
    return base.join(told, "query_id", "left").join(held, "query_id", "left").select("query_id", message.alias("message"))


@query()
def rag_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users ask in every hundredth conversation, embedded by the stand-in model and answered from all documents."""
    embed = vectors.hashing_embedder()
    texts = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source")
    stored = vectors.embedded(texts, "id", "text", embed).join(texts, "id")
    questions = R.table(spark, sf_dir, "conversations").where("role = 'user' and conv_id % 100 = 0").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question")
    )
    asked_vectors = vectors.embedded(questions, "query_id", "question", embed).withColumnRenamed("vector", "query_vector").join(questions, "query_id")
    found = vectors.cosine_top_k(asked_vectors.select("query_id", "query_vector"), stored.select("id", "vector"))
    named = texts.select(
        "id", F.col("id").cast("string").alias("chunk_id"), F.col("source").alias("document_id"), F.col("id").alias("page_start"), F.col("id").alias("page_end"),
        F.col("source").alias("section_title"), CORPUS.coverage_type(F.col("source"), F.col("text")).alias("coverage_type"), "text", F.lit(None).cast("string").alias("related_chunk_id"),
    )
    hits = found.join(named, "id").drop("id")
    return retrieval.answers(questions.select("query_id", "question"), hits, named.drop("id"))


# Stores and scopes


@query("SELECT doc_id, n_chars FROM documents ANTI JOIN labels USING (doc_id)")
def embed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.pending(docs(spark, sf_dir).select("doc_id", "n_chars"), R.table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, CAST(quality AS BIGINT) AS value FROM labels UNION ALL SELECT doc_id, n_chars FROM documents ANTI JOIN labels USING (doc_id)")
def embedding_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = R.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("value"))
    return vectors.upsert(old, docs(spark, sf_dir).select("doc_id", F.col("n_chars").alias("value")), "doc_id")


@query("SELECT doc_id, vec_id AS chunk_id, n_chars, label FROM documents JOIN embeddings ON doc_id = vec_id")
def chunk_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs(spark, sf_dir).select("doc_id", F.col("doc_id").alias("chunk_id"), "n_chars")
    e = R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("chunk_id"), "label")
    return joined(found, e)


@query("""
    WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'u' END AS user_id, CASE WHEN doc_id % 4 = 1 THEN '' ELSE 't' END AS trip_id,
               CASE WHEN doc_id % 3 = 0 THEN 'p' WHEN doc_id % 3 = 1 THEN '' END AS policy_id, CASE WHEN doc_id % 5 = 0 THEN 'd' END AS document_id FROM documents),
         m AS (SELECT *, coalesce(policy_id, '') = '' AS missing FROM s)
    SELECT doc_id, CASE WHEN missing AND coalesce(user_id, '') = '' THEN 'local-user-' || doc_id ELSE user_id END AS user_id,
           CASE WHEN missing AND coalesce(trip_id, '') = '' THEN 'local-trip-' || doc_id ELSE trip_id END AS trip_id,
           CASE WHEN missing THEN CAST(doc_id AS VARCHAR) ELSE policy_id END AS policy_id,
           CASE WHEN missing AND coalesce(document_id, '') = '' THEN CAST(doc_id AS VARCHAR) ELSE document_id END AS document_id
    FROM m""")
def scope_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return with_local_scope(
        docs(spark, sf_dir).select(
            "doc_id", F.when(d % 4 == 0, "u").alias("user_id"), F.when(d % 4 == 1, "").otherwise("t").alias("trip_id"),
            F.when(d % 3 == 0, "p").when(d % 3 == 1, "").alias("policy_id"), F.when(d % 5 == 0, "d").alias("document_id"),
        )
    )


@query("SELECT conv_id AS \"convId\", turn, role, text IS NOT NULL AND role IN ('user', 'assistant') AS \"isValid\" FROM conversations")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = R.table(spark, sf_dir, "conversations").withColumn("known_role", F.when(F.col("role").isin("user", "assistant"), F.col("role")))
    return ingest.camel_case(told.withColumn("is_valid", ingest.valid(told, ("text", "known_role"))).select("conv_id", "turn", "role", "is_valid"))


# Boxes


@query(f"WITH {S.OBJECTS} SELECT table_id, object_id, score FROM objects WHERE label = 'table row' AND score > 0.7")
def box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.detected(R.objects(spark, sf_dir), (boxes.ROW_LABEL,), boxes.DETECTED).select("table_id", "object_id", "score")


@query(f"WITH {S.OBJECTS}, {S.merged_boxes('merged', 'objects', 'x')} SELECT * FROM merged")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.merge_intervals(R.objects(spark, sf_dir), "x")


@query(f"WITH {S.OBJECTS}, {S.merged_boxes('merged', 'objects', 'y')}, {S.filled_boxes('filled', 'merged', 'y', '0.0::DOUBLE', '1000.0::DOUBLE')} SELECT * FROM filled")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.fill_gaps(boxes.merge_intervals(R.objects(spark, sf_dir), "y"), "y", F.lit(0.0), F.lit(1000.0))


_GRID = f"""{S.OBJECTS},
    row_objects AS (SELECT * FROM objects WHERE label = 'table row' AND score > 0.5),
    col_objects AS (SELECT * FROM objects WHERE label = 'table column' AND score > 0.5),
    {S.merged_boxes('row_merged', 'row_objects', 'y')}, {S.filled_boxes('r', 'row_merged', 'y', '0.0::DOUBLE', '800.0::DOUBLE')},
    {S.merged_boxes('col_merged', 'col_objects', 'x')}, {S.filled_boxes('c', 'col_merged', 'x', '0.0::DOUBLE', '700.0::DOUBLE')},
    cells AS (SELECT table_id, r.group_no AS row_no, r.ymin, r.ymax, c.group_no AS col_no, c.xmin, c.xmax FROM r JOIN c USING (table_id))"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    objects = R.objects(spark, sf_dir)
    edge = lambda v: F.lit(v)
    tables = objects.select("table_id").distinct().select("table_id", edge(0.0).alias("t_xmin"), edge(0.0).alias("t_ymin"), edge(700.0).alias("t_xmax"), edge(800.0).alias("t_ymax"))
    kind = lambda label: boxes.detected(objects, (label,), boxes.STRUCTURED)
    return boxes.grid_sides(kind(boxes.ROW_LABEL), kind(boxes.COLUMN_LABEL), tables)


@query(f"WITH {_GRID} SELECT * FROM cells")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = sides(spark, sf_dir)
    return rows.join(columns, "table_id")


_TEXTS = f"""
    WITH {_GRID}, words AS (SELECT l_orderkey AS table_id, l_linenumber * 1000000 + l_partkey AS word_no, (l_partkey % 700) + 0.5 AS cx, (l_suppkey % 800) + 0.5 AS cy, l_shipdate::DATE::VARCHAR AS word FROM lineitem)
    SELECT c.table_id, row_no, col_no, coalesce(string_agg(word, ' ' ORDER BY word_no, word), '') AS text
    FROM cells c LEFT JOIN words w ON w.table_id = c.table_id AND cx >= xmin AND cx < xmax AND cy >= ymin AND cy < ymax GROUP BY ALL"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_partkey") % 700, F.col("l_suppkey") % 800
    return R.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")).alias("word_no"), x.alias("x0"), (x + 1).alias("x1"), y.alias("y0"), (y + 1).alias("y1"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("text"),
    )


@query(_TEXTS)
def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.cell_texts(grid_cells(spark, sf_dir), words(spark, sf_dir))


@query(_TEXTS)
def grid_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_texts by range search, as large tables need it."""
    return boxes.grid_texts(*sides(spark, sf_dir), words(spark, sf_dir))


@query(f"""
    WITH {S.OBJECTS}, p AS (SELECT table_id, object_id, greatest(0.0, xmin - 10) AS xmin, greatest(0.0, ymin - 10) AS ymin, least(600.0, xmax + 10) AS xmax, least(700.0, ymax + 10) AS ymax FROM objects)
    SELECT table_id, object_id, round((xmin + 12) / (200 / 72), 6) AS xmin, round((ymin + 12) / (200 / 72), 6) AS ymin,
           round((xmax + 12) / (200 / 72), 6) AS xmax, round((ymax + 12) / (200 / 72), 6) AS ymax FROM p""")
def coord_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    cropped = boxes.padded(R.objects(spark, sf_dir), F.lit(600), F.lit(700))
    point = lambda c: F.round(boxes.to_points(F.col(c), F.lit(12.0)), 6).alias(c)
    return cropped.select("table_id", "object_id", *map(point, ("xmin", "ymin", "xmax", "ymax")))


# Evaluation


def truth_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a benchmark item as cells; its table is the item."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return R.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("table_id"), F.explode(words).alias("cell"))


def candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to the items, by number, as their candidates."""
    n = R.table(spark, sf_dir, "benchmark").count() or 1
    return docs(spark, sf_dir).select(F.expr(f"doc_id % {n}").alias("table_id"), F.expr(f"doc_id div {n}").alias("candidate"), "text")


@query()
def containment_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each cell in each of its candidates."""
    found = candidate_texts(spark, sf_dir).join(reports.cells_of(truth_cells(spark, sf_dir), ["table_id"]), "table_id")
    ratios = found.select("table_id", "candidate", "cells", reports.containments(F.col("cells"), F.col("text")).alias("ratios"))
    return ratios.select("table_id", "candidate", F.explode(F.arrays_zip("cells", "ratios")).alias("x")).select("table_id", "candidate", F.col("x.cells").alias("cell"), F.col("x.ratios").alias("ratio"))


@query()
def recall_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recall_report with cells found at a share of 0.7, which SQL can't say."""
    return reports.best_candidates(truth_cells(spark, sf_dir), candidate_texts(spark, sf_dir))


_RECALL = f"""
    n AS (SELECT count(*) AS n FROM benchmark),
    truth AS (SELECT item_id AS table_id, unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS cell FROM benchmark),
    candidates AS (SELECT doc_id % n AS table_id, doc_id // n AS candidate, text FROM documents, n),
    each AS (
        SELECT table_id, candidate, avg(CASE WHEN contains({S.no_space("text")}, {S.no_space("cell")}) THEN 1.0 ELSE 0.0 END) AS recall
        FROM truth JOIN candidates USING (table_id) GROUP BY ALL),
    best AS (SELECT table_id, arg_max(recall, (recall, -candidate)) AS recall, arg_max(candidate, (recall, -candidate)) AS candidate, count(*) AS n_candidates FROM each GROUP BY table_id)"""


@query(f"""
    WITH {_RECALL} SELECT table_id, coalesce(recall, 0.0) AS recall, candidate, coalesce(n_candidates, 0) AS n_candidates
    FROM (SELECT DISTINCT table_id FROM truth) LEFT JOIN best USING (table_id)""")
def recall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_candidates(truth_cells(spark, sf_dir), candidate_texts(spark, sf_dir), reports.exact_containments)


@query(f"""
    WITH {_RECALL}, a AS (SELECT table_id, avg(recall) AS layout_recall, count(*) AS layout_rows FROM each WHERE candidate = 0 GROUP BY table_id),
    b AS (SELECT table_id, recall AS model_recall FROM best), j AS (SELECT * FROM a JOIN b USING (table_id))
    SELECT table_id, layout_recall, CAST(layout_rows AS DOUBLE) AS layout_rows, model_recall FROM j
    UNION ALL SELECT -1, avg(layout_recall), avg(layout_rows), avg(model_recall) FROM j""")
def recall_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate 0 stands for the one layout text of a table, all candidates for a model's."""
    truth = truth_cells(spark, sf_dir)
    scored = reports.scored_candidates(truth, candidate_texts(spark, sf_dir), reports.exact_containments)
    first = scored.where("candidate = 0").select("table_id", F.col("recall").alias("layout_recall"), F.lit(1).cast("long").alias("layout_rows"))
    best = reports.best_of(scored, truth).where("candidate is not null").select("table_id", F.col("recall").alias("model_recall"))
    return reports.recall_report(first, best).fillna({"table_id": -1})  # the row of means


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def longest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each group by an order, as best candidates are picked."""
    found = docs(spark, sf_dir).groupBy("source").agg(F.max_by(F.struct("doc_id", "n_chars"), F.struct("n_chars", -F.col("doc_id"))).alias("b"))
    return found.select("source", "b.doc_id", "b.n_chars")
