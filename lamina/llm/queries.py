"""The corpus operators as queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    mtree_search,
    permutation_index,
    quality,
    secret_scan,
    sentence_pieces,
    simhash_dedup,
    source_mix,
    spelling_variants,
    text_fingerprints,
    token_alignment,
    token_files,
    toxicity,
)
from .common import table

#: Vocabulary files of public tokenizers; operators take a path.
PIECES, BYTE_BPE = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.json"))
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], told.schema)
    return chat_format.read_back(chat_format.formatted(chat_format.reply_tree(told.unionByName(own))))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_report(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_fingerprints.fingerprint_report(table(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip_report(table(spark, sf_dir, "documents"), PIECES)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = token_files.write_segments(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)
    return token_files.read_documents(segments)


def op10_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mtree_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op11_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_report(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variant_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_source_mix": op3_source_mix,
    "op4_toxicity": op4_toxicity,
    "op5_text_fingerprints": op5_text_fingerprints,
    "op6_quality": op6_quality,
    "op7_secret_scan": op7_secret_scan,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_token_files": op9_token_files,
    "op10_mtree_topk": op10_mtree_topk,
    "op11_permutation_ann": op11_permutation_ann,
    "op12_token_alignment": op12_token_alignment,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op2_chat_format": r"""
        WITH told AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
               CAST(sum(14 + length(regexp_replace(role, '\\|###|</turn>|:', '_\0', 'g'))
                        + length(regexp_replace(text, '\\|###|</turn>', '_\0', 'g'))) AS BIGINT) AS formatted_chars
        FROM told GROUP BY conv_id""",
    "op3_source_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        named AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM per_source),
        weighed AS (SELECT *, (sid - 1) % 3 + 1 AS weight, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / ((sid - 1) % 3 + 1) AS ratio FROM named),
        lesser AS (
            SELECT *, CAST(coalesce(sum(cap) OVER w, 0) AS BIGINT) AS caps, CAST(coalesce(sum(weight) OVER w, 0) AS BIGINT) AS weights
            FROM weighed WINDOW w AS (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        levels AS (
            SELECT max(CAST(total - caps AS DOUBLE) / CAST(all_weights - weights AS DOUBLE)) AS level
            FROM lesser, (SELECT CAST(sum(source_size) AS BIGINT) AS total, CAST(sum(weight) AS BIGINT) AS all_weights FROM weighed)),
        sources AS (
            SELECT source, source_size, weight, least(CAST(cap AS DOUBLE), level * CAST(weight AS DOUBLE)) AS target,
                   CAST(round(least(CAST(cap AS DOUBLE), level * CAST(weight AS DOUBLE))) AS BIGINT) AS demand
            FROM weighed, levels),
        units AS (
            SELECT doc_id, source, size, count(*) AS n_same,
                   CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR))[:13] AS BIGINT) AS place
            FROM sized GROUP BY ALL),
        placed AS (
            SELECT u.doc_id, u.size, u.n_same, s.source_size, s.weight, s.target, s.demand, u.size * u.n_same AS words,
                   CAST(coalesce(sum(u.size * u.n_same) OVER (
                       PARTITION BY s.source ORDER BY u.place, u.doc_id NULLS FIRST, u.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM units u JOIN sources s ON u.source IS NOT DISTINCT FROM s.source),
        copies AS (SELECT *, unnest(range(n_same)) AS copy, row_number() OVER () AS unit FROM placed),
        passes AS (
            SELECT *, greatest(0, least(words, demand - start - source_size * e)) AS given,
                   least(1.0::DOUBLE, CAST(start + source_size * e AS DOUBLE) / CAST(greatest(1, demand) AS DOUBLE)) AS share,
                   CAST((weight - 2) AS DOUBLE) * 0.5::DOUBLE AS slope
            FROM copies, range(3) AS epochs(e)),
        dealt AS (
            SELECT *, given // n_same + CASE WHEN copy < given % n_same THEN 1 ELSE 0 END AS got,
                   CASE WHEN weight = 2 THEN share
                        ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END AS due
            FROM passes)
        SELECT doc_id, size, source_size, target, CAST(sum(got) AS BIGINT) AS taken, min(due) FILTER (WHERE got > 0) AS position
        FROM dealt GROUP BY doc_id, size, source_size, target, unit, copy""",
    "op10_mtree_topk": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
}
