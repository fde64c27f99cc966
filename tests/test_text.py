"""Column functions against Python's own string methods, and title rules."""

import random

import pytest
from lamina.functions import text as T
from lamina.functions.rules import KOREAN_POLICY, keywords_from
from pyspark.sql import functions as F

SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def strings():
    rng = random.Random(1)
    pool = [*SPACES, "a", "B", "é", "가", "😀", "."]
    return ["".join(rng.choices(pool, k=rng.randint(0, 20))) for _ in range(400)] + ["", " ", "x"]


def test_white_space_forms(spark):
    values = strings()
    assert column(spark, values, T.stripped) == [v.strip() for v in values]
    assert column(spark, values, T.collapsed) == [" ".join(v.split()) for v in values]
    assert column(spark, values, T.match_form) == ["".join(v.split()).lower() for v in values]
    assert column(spark, values, T.clean_lines) == [[x.strip() for x in v.splitlines() if x.strip()] for v in values]


def test_control_characters_go_and_layout_stays(spark):
    dirty = "\x02열쇠는\x1f 문\x00 옆에\r\n둘째\t줄\x7f\x0b 끝"
    assert column(spark, [dirty], T.sanitised) == ["열쇠는 문 옆에\r\n둘째\t줄 끝"]


def test_page_numbers(spark):
    values = ["– 7 –", "408", "30개", "9. 아침", "9.아침", "3\n저녁", "12345", "", "넷"]
    assert column(spark, values, T.is_page_number) == [True, True, True, False, True, True, True, False, False]


def test_names_and_labels(spark):
    n = column(spark, ["7", "12345"], lambda c: T.chunk_name(F.lit("a"), c.cast("int")))
    assert n == ["a_0007", "a_12345"]
    assert column(spark, ["/x/a.b.json", "c"], T.file_stem) == ["a.b", "c"]
    assert T.camel("source_chunk_ids") == "sourceChunkIds" and T.snake("sourceChunkIds") == "source_chunk_ids"
    assert column(spark, ["가" * 500, "가" * 200], T.quote) == ["가" * 200 + "...", "가" * 200]


def test_titles(spark):
    lines = [
        "제1조(보상하는 손해)", "제 3 장  총칙", "12. 보험금 청구", "가. 정의는 다음", "해외 수하물 및 항공기 지연 특별약관", "보상하지 않는 손해",
        "창구는 받은 서류를 차례로 읽고 빠진 것이 있으면 다시 알려 드립니다.", "목차 제1조(보상)", "제1조(a, b, c, d)", "수하물",
    ]
    assert column(spark, lines, KOREAN_POLICY.is_title) == [True, True, True, True, True, True, False, False, False, False]
    assert column(spark, lines[:6], KOREAN_POLICY.title_of) == ["보상하는 손해", "총칙", "보험금 청구", "정의는 다음", "특별약관", "보상하지 않는 손해"]


@pytest.mark.parametrize("title,text,want", [
    ("제9조(이럴 때 보상하지 않는 사항)", "다음은 모두 빠집니다", "excluded"),
    ("열 번째 이야기", "여기 적은 것은 보상하지 않는 손해", "excluded"),
    ("보상하지\t않는\n 손해", "아무 말", "excluded"),
    ("보험금의 청구", "x", "procedure"),
    ("용어의 정의", "x", "definition"),
    ("x", "가" * 500 + "보상하지 않는 손해", "included"),
])
def test_coverage_types(spark, title, text, want):
    assert column(spark, [text], lambda c: KOREAN_POLICY.coverage_type(F.lit(title), c)) == [want]


def test_longest_keyword_first_then_given_order(spark):
    words = keywords_from({"ab": "short", "ab c": {"primary_category": "long", "secondary_category": "s"}, "xyz": "other", "bad": 3, "none": {}})
    assert [k.keyword for k in words] == ["ab c", "xyz", "ab"]
    rules = KOREAN_POLICY.__class__(title_patterns=(), keywords=words)
    got = column(spark, ["xyz A b C", "ab", "q"], lambda c: rules.category(F.lit(""), c))
    assert [tuple(r) for r in got] == [("long", "s", "ab c"), ("short", None, "ab"), (None, None, None)]
