"""The pipeline by ranges of pages and chunks gives what the pipeline by documents gives."""

import random

import pytest
from lamina.functions.rules import CORPUS
from lamina.operators import chunks as C
from lamina.operators import large_documents as L
from lamina.plans import relations as R
from oracle import SF
from pyspark.sql import functions as F


def told(df):
    return sorted(map(repr, (r.asDict() for r in df.select(C.CHUNK_COLUMNS).collect())))


@pytest.mark.parametrize("sizes", [(1, 2), (3, 7), (1000, 20_000)])
def test_equals_the_pipeline_by_documents(spark, sizes):
    pages = R.pages(spark, SF).where("doc_id % 4 = 0 or length(text) > 3000")
    got = told(L.chunk_pipeline(pages, CORPUS, *sizes))
    assert got == told(C.chunk_pipeline(pages, CORPUS)) and len(got) > 100


def test_runs_of_random_chunks(spark):
    rng = random.Random(4)
    schema = "chunk_id string, doc_id int, ordinal long, page_start long, page_end long, section_title string, coverage_type string, text string, char_count long, matched_category string, secondary_category string, matched_keyword string, related_chunk_id string"
    rows = []
    for doc in range(40):
        for k in range(1, rng.randint(1, 60)):
            n, category = rng.choice([1, 40, 120, 299, 300, 301, 900]), rng.choice([None, None, "", "a", "b"])
            rows.append((f"{doc}_{k}", doc, k, k, k, f"t{k}", rng.choice(["included", "excluded"]), "x" * n, n, category, category, category, None))
    frame = spark.createDataFrame(rows, schema).cache()
    for size in (1, 5, 1000):
        assert told(L.merge_small(frame, CORPUS, size)) == told(C.merge_small(frame, CORPUS))
    assert told(L.link_pairs(frame)) == told(C.link_pairs(frame)) and told(L.split_large(frame, CORPUS, 3)) == told(C.split_large(frame, CORPUS))
    assert L.chunk_pipeline(R.pages(spark, SF).limit(0), CORPUS).collect() == []


def test_one_document_is_many_tasks(spark):
    line = F.when(F.pmod(F.xxhash64("id"), F.lit(9)) == 0, F.concat(F.lit("title "), F.col("id").cast("string"))).otherwise(
        F.concat(F.lit("a line of the only document that is longer than a title may be "), F.col("id").cast("string"))
    )
    lines = spark.range(60_000).select(F.floor(F.col("id") / 20).alias("page"), F.struct("id", line.alias("line")).alias("x"))
    pages = lines.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("x"))["line"], "\n").alias("text")).withColumn("doc_id", F.lit(1))
    made = L.chunk_pipeline(pages, CORPUS, 50, 200).cache()
    facts = made.agg(F.count("*"), F.max("ordinal"), F.countDistinct("ordinal")).first()
    assert facts[0] == facts[1] == facts[2] > 2000
    numbered = L.running(pages.select("doc_id", "page", F.lit(1).cast("long").alias("n"), F.floor(F.col("page") / 50).alias("__range")), ["doc_id"], ["page"], "n")
    assert numbered.where("n <> page + 1").count() == 0
    assert made.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1


def random_pages(spark, documents=25):
    """Pages whose cuts fall between linked chunks, small chunks, chunks in parts, and pages without a number."""
    rng = random.Random(7)
    words = ["ontion", "thanedble", "queque", "nicht", "tiontion", "plain", "plain", "plain"]

    def page():
        lines = []
        for _ in range(rng.randint(3, 12)):
            if rng.random() < 0.35:
                lines.append(f"{rng.choice(['heat', 'title', 'aire', 'title'])} {rng.choice(words)} {rng.randint(0, 99)}")
            lines.append(f"{rng.choice(words)} " + "".join(rng.choice("abc de") for _ in range(rng.choice([60, 130, 310, 310, 1500, 4500]))))
        return "\n".join(lines)

    rows = [(d, n, page()) for d in range(documents) for n in [*([None] if d % 5 == 0 else []), *range(-2 if d % 7 == 0 else 1, rng.randint(1, 40))]]
    return spark.createDataFrame(rows, "doc_id int, page int, text string").cache()


def test_segments_of_random_documents(spark):
    pages = random_pages(spark)
    want = told(C.chunk_pipeline(pages, CORPUS))
    linked = sum("related_chunk_id': None" not in x for x in want)
    assert len(want) > 2000 and linked > 20
    lined = C.content_lines(pages, CORPUS)
    for a_range in (1, 4):
        known = L.cuts(lined, CORPUS, a_range).collect()
        assert sum(len(r["cuts"]) for r in known) > 25 and not any(r["long"] for r in known)
        assert told(L.chunk_pipeline(pages, CORPUS, a_range, 7)) == want


def test_documents_of_too_large_segments_go_by_sums(spark):
    pages = R.pages(spark, SF).where("doc_id % 4 = 0 or length(text) > 3000")
    assert sum(r["long"] for r in L.cuts(C.content_lines(pages, CORPUS), CORPUS, 3, 9000).collect()) > 3
    assert told(L.chunk_pipeline(pages, CORPUS, 3, 7, 9000)) == told(C.chunk_pipeline(pages, CORPUS))


def dealt(df):
    """Exchanges of the plan that ran, and their bytes."""
    df.collect()
    found, rest = [], [df._jdf.queryExecution().executedPlan()]
    while rest:
        node = rest.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            found.append(node.metrics().apply("dataSize").value())
        rest += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        rest += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_texts_are_dealt_once(spark):
    """Twice, where documents have several segments; by running sums, it was some ten times."""
    assert len(dealt(L.chunk_pipeline(R.pages(spark, SF), CORPUS))) == 1
    pages = random_pages(spark)
    size = pages.agg(F.sum(F.octet_length("text"))).first()[0]
    assert 0.5 * size < sum(dealt(L.chunk_pipeline(pages, CORPUS, 4))) < 3.5 * size
