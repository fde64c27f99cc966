"""Retrieved chunks to evidence, prompts and answers.

hits: query_id, rank, chunk_id and the chunk columns that each function reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_stem, page_label, quote

# Labels and wording of the Korean prompts.
COVERAGE_LABELS = {"included": "보장", "excluded": "면책(보상하지 않음)", "procedure": "청구절차", "definition": "용어정의"}
NO_EVIDENCE = "제공된 약관에서 관련 근거를 찾을 수 없습니다. 질문을 조금 더 구체적으로 적어주시거나, 해당 약관이 분석되었는지 확인해 주세요."
EVIDENCE, CONTRACT, HISTORY, EVIDENCE_HEAD, QUESTION_HEAD = "근거", "[가입 정보]", "[이전 대화]", "[약관 근거]", "[질문]"
SUBSCRIBED, NOT_SUBSCRIBED, LIMIT, WON, USER, ASSISTANT = "가입", "미가입", "한도", "원", "사용자", "어시스턴트"


def hit_rows(chunks: DataFrame) -> DataFrame:
    """chunks as search gives them: where document_id is missing, the stem of source_file, if chunks have one, names the document."""
    named = F.nullif(F.col("document_id"), F.lit("")) if "document_id" in chunks.columns else F.lit(None).cast("string")
    stem = file_stem(F.col("source_file")) if "source_file" in chunks.columns else F.lit(None).cast("string")
    return chunks.withColumn("document_id", F.coalesce(named, stem))


def by_ids(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of chunks in the order of ids (query_id, ids array<string>); unknown ids are left out, scores are 0."""
    wanted = ids.select("query_id", F.posexplode("ids").alias("pos", "chunk_id"))
    return wanted.join(chunks, "chunk_id").withColumn("score", F.lit(0.0))


def with_related(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits and, after them in order of first mention, related chunks that are not among them; one step, scores 0."""
    wanted = (
        hits.where("related_chunk_id <> ''")
        .groupBy("query_id", F.col("related_chunk_id").alias("chunk_id"))
        .agg(F.min("rank").alias("first"))
        .join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        .join(chunks.drop("rank", "score", "query_id"), "chunk_id")
    )
    last = hits.groupBy("query_id").agg(F.max("rank").alias("last"))
    order = Window.partitionBy("query_id").orderBy("first")
    added = wanted.join(last, "query_id").withColumn("rank", F.col("last") + F.row_number().over(order)).withColumn("score", F.lit(0.0))
    return hits.unionByName(added.select(hits.columns))


def sources(hits: DataFrame) -> DataFrame:
    """Citations: the chunk's first page and first characters."""
    return hits.select("query_id", "rank", "chunk_id", "document_id", F.col("page_start").alias("page"), quote(F.col("text")).alias("quote"))


def evidence(hits: DataFrame) -> DataFrame:
    """(query_id, evidence): numbered, labelled chunks."""
    labels = F.create_map(*[F.lit(x) for kv in COVERAGE_LABELS.items() for x in kv])
    label = F.coalesce(F.try_element_at(labels, F.col("coverage_type")), F.col("coverage_type"))
    ordered = F.array_sort(
        F.collect_list(F.struct("rank", label.alias("label"), "section_title", page_label(F.col("page_start"), F.col("page_end")).alias("pages"), "text"))
    )
    block = lambda x, i: F.concat(
        F.lit(f"[{EVIDENCE} "), (i + 1).cast("string"), F.lit("] ["), x["label"], F.lit("] "), x["section_title"], F.lit(" ("), x["pages"], F.lit(")\n"), x["text"]
    )
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, block), "\n\n").alias("evidence"))


def contract_block(coverages: Column) -> Column:
    """From array<struct<name, subscribed, limitAmount>>; empty without coverages."""
    line = lambda c: F.concat(
        F.lit("- "), F.coalesce(c["name"], F.lit("None")), F.lit(": "), F.when(c["subscribed"], F.lit(SUBSCRIBED)).otherwise(F.lit(NOT_SUBSCRIBED)),
        F.when(c["limitAmount"].isNotNull(), F.concat(F.lit(f" / {LIMIT} "), F.format_number(c["limitAmount"], 0), F.lit(WON))).otherwise(F.lit("")),
    )
    return F.when(F.size(coverages) > 0, F.concat(F.lit(CONTRACT + "\n"), F.array_join(F.transform(coverages, line), "\n"))).otherwise(F.lit(""))


def history_blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, history) from turns (conv_id, turn, role, text)."""
    who = F.when(F.col("role") == "user", F.lit(USER)).otherwise(F.lit(ASSISTANT))
    line = F.concat(who, F.lit(": "), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.concat(F.lit(HISTORY + "\n"), F.array_join(ordered["line"], "\n")).alias("history"))


def user_message(contract: Column, history: Column, found: Column, question: Column) -> Column:
    """Contract, history, evidence and question, without empty ones of the first two."""
    given = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(
        "\n\n", given(contract), given(history), F.concat(F.lit(EVIDENCE_HEAD + "\n"), F.coalesce(found, F.lit(""))), F.concat(F.lit(QUESTION_HEAD + "\n"), question)
    )


def first_sentences(message: Column) -> Column:
    """A stand-in answerer, which takes no instructions: the start of the first piece of evidence."""
    return quote(F.regexp_extract(message, r"(?s)\[" + EVIDENCE + r" 1\] [^\n]*\n(.*?)(\n\n|$)", 1))


def chat_request(message: Column, instructions: str, model: str = "", temperature: float = 0.0) -> Column:
    """JSON of what a chat model is asked: the instructions as the system's message, then the user's. Answers don't vary at temperature 0."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.lit(temperature).alias("temperature"), F.array(turn("system", F.lit(instructions)), turn("user", message)).alias("messages")))


def answers(questions: DataFrame, hits: DataFrame, chunks: DataFrame, answerer=first_sentences) -> DataFrame:
    """(query_id, answer, sources): without hits a fixed answer and no sources; the answerer sees messages only.

    questions: query_id, question, and if given contract (an array of coverages, as contract_block takes it) and history (a block).
    """
    found = with_related(hits, chunks)
    cited = sources(found)
    packed = cited.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "document_id", "page", "quote"))),
            lambda s: F.struct(s["chunk_id"].alias("chunkId"), s["document_id"].alias("documentId"), s["page"].alias("page"), s["quote"].alias("quote")),
        ).alias("sources")
    )
    none = F.array().cast("array<struct<chunkId:string,documentId:string,page:bigint,quote:string>>")
    joined = questions.join(evidence(found), "query_id", "left").join(packed, "query_id", "left")
    contract = contract_block(F.col("contract")) if "contract" in questions.columns else F.lit("")
    history = F.col("history") if "history" in questions.columns else F.lit("")
    message = user_message(contract, history, F.col("evidence"), F.col("question"))
    return joined.select(
        "query_id",
        F.when(F.col("evidence").isNull(), F.lit(NO_EVIDENCE)).otherwise(answerer(message)).alias("answer"),
        F.coalesce("sources", none).alias("sources"),
    )
