"""Keywords by joins against the CASE, and many of them."""

import random
from dataclasses import replace

from lamina.functions.rules import CORPUS, keywords_from
from lamina.operators import keywords as K
from pyspark.sql import functions as F

COLUMNS = ("matched_category", "secondary_category", "matched_keyword")


def test_equals_the_case(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcé한", k=rng.choice([1, 2, 3, 4, 6]))) for _ in range(70)]
    table = {w: rng.choice(["x", {"primary_category": "y", "secondary_category": "z"}]) for w in words}
    rules = replace(CORPUS, keywords=keywords_from(table))
    texts = [(i, "".join(rng.choices("abcdé한 \n", k=3)), "".join(rng.choices("ABcdeé한 ", [1, 1, 1, 6, 6, 1, 1, 2], k=rng.randint(0, 40)))) for i in range(400)]
    df = spark.createDataFrame([*texts, (900, None, "abc"), (901, "a", None), (902, "", "")], "doc_id int, title string, text string")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in K.keyword_matches(df, K.keyword_table(spark, rules.keywords)).collect()}
    want = {r["doc_id"]: tuple(r["c"][c] for c in COLUMNS) for r in df.select("doc_id", rules.category(F.col("title"), F.col("text")).alias("c")).collect()}
    assert got == want and len({v for v in want.values()}) > 20
    empty = keywords_from({"": "all", "abc": "x"})
    got = {r["doc_id"]: r["matched_category"] for r in K.keyword_matches(df, K.keyword_table(spark, empty)).collect()}
    assert got[902] == "all" and got[900] is None and set(got.values()) <= {"all", "x", None}
    assert K.keyword_matches(df.limit(0), K.keyword_table(spark, empty)).collect() == []


def test_fifty_thousand_keywords(spark):
    table = spark.range(50_000).selectExpr("id as rank", "concat('w', conv(id * 7919, 10, 36), 'q') as form").selectExpr("rank", "lower(form) as form", "'c' as matched_category", "cast(null as string) as secondary_category", "form as matched_keyword")
    texts = spark.range(200).selectExpr("id as doc_id", "'t' as title", "concat('some words w', lower(conv(id * 7919, 10, 36)), 'q end') as text")
    got = K.keyword_matches(texts, table).join(table.select("matched_keyword", "rank"), "matched_keyword")
    assert got.where("rank <= doc_id").count() == 200


def test_pieces_without_a_lambda_for_each_letter(spark):
    df = spark.createDataFrame([("a𝄞b한",), ("ab",), (None,)], "form string")
    assert "lambda" not in df.select(K.pieces(F.col("form"), 3))._jdf.queryExecution().optimizedPlan().toString()
    texts = spark.createDataFrame([(1, "", "xa𝄞b한y"), (2, "", "a𝄞"), (3, "", "a?b한")], "doc_id int, title string, text string")
    rules = replace(CORPUS, keywords=keywords_from({"𝄞b한": "x", "a𝄞": "y"}))
    got = {r["doc_id"]: r["matched_category"] for r in K.keyword_matches(texts, K.keyword_table(spark, rules.keywords)).collect()}
    assert got == {1: "x", 2: "y", 3: None}
