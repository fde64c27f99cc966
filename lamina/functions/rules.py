"""Rule sets: what counts as a title, and which keywords give categories and coverage types."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, any_of, match_form, once, stripped


@dataclass(frozen=True)
class Keyword:
    keyword: str
    primary: str
    secondary: str | None = None

    @property
    def form(self) -> str:
        return "".join(self.keyword.split()).lower()


def keywords_from(mapping: dict) -> tuple[Keyword, ...]:
    """From a mapping of keyword to category or {primary_category, secondary_category}: longest match form first, else in given order.

    Entries of another type or without a primary category are left out.
    """
    found = []
    for word, value in mapping.items():
        if isinstance(value, str):
            value = {"primary_category": value}
        if isinstance(value, dict) and value.get("primary_category"):
            found.append(Keyword(word, value["primary_category"], value.get("secondary_category")))
    return tuple(sorted(found, key=lambda k: -len(k.form)))


@dataclass(frozen=True)
class Rules:
    """Title patterns carry the number of the group that is the title."""

    title_patterns: tuple[tuple[str, int], ...]
    noise_words: tuple[str, ...] = ()
    title_chars: tuple[int, int] = (2, 120)
    most_commas: int = 2
    keywords: tuple[Keyword, ...] = ()
    excluded: tuple[str, ...] = ()
    procedure: tuple[str, ...] = ()
    definition: tuple[str, ...] = ()
    preamble: str = "문서 시작"
    coverage_chars: int = 500
    toc_lines: int = 3
    toc_chars: int = 28
    small: int = 300
    large: int = 2000

    def with_keywords(self, path: str) -> Rules:
        """With the keywords of a JSON file."""
        with open(path, encoding="utf-8") as file:
            return replace(self, keywords=keywords_from(json.load(file)))

    def is_title(self, line: Column) -> Column:
        line = stripped(line)
        fits = F.length(line).between(*self.title_chars) & (F.length(line) - F.length(F.replace(line, F.lit(","))) <= self.most_commas)
        matches = F.lit(False)
        for pattern, _ in self.title_patterns:
            matches = matches | line.rlike(pattern)
        return fits & ~any_of(line, list(self.noise_words)) & matches

    def title_of(self, line: Column) -> Column:
        line = stripped(line)
        out = line
        for pattern, group in reversed(self.title_patterns):
            out = F.when(line.rlike(pattern), stripped(F.regexp_extract(line, pattern, group))).otherwise(out)
        return out

    def coverage_type(self, title: Column, text: Column) -> Column:
        """excluded before procedure before definition; included if none."""
        seen = match_form(F.concat(title, F.lit("\n"), F.substring(text, 1, self.coverage_chars)))
        forms = lambda words: ["".join(w.split()).lower() for w in words]
        return once(
            seen,
            lambda s: F.when(any_of(s, forms(self.excluded)), "excluded")
            .when(any_of(s, forms(self.procedure)), "procedure")
            .when(any_of(s, forms(self.definition)), "definition")
            .otherwise("included"),
        )

    def category(self, title: Column, text: Column) -> Column:
        """struct<matched_category, secondary_category, matched_keyword> of the first keyword in title or text; a null-filled struct if none.

        One CASE over the keywords: no join, and the first match ends it.
        """
        none = F.lit(None).cast("string")
        entry = lambda p, s, k: F.struct(p.alias("matched_category"), s.alias("secondary_category"), k.alias("matched_keyword"))

        def first(seen: Column) -> Column:
            out = None
            for k in self.keywords:
                value = entry(F.lit(k.primary), F.lit(k.secondary).cast("string"), F.lit(k.keyword))
                test = F.contains(seen, F.lit(k.form))
                out = F.when(test, value) if out is None else out.when(test, value)
            return entry(none, none, none) if out is None else out.otherwise(entry(none, none, none))

        return once(match_form(F.concat(title, F.lit("\n"), text)), first)


# The patterns, word lists and thresholds for Korean travel insurance policies.
KOREAN_POLICY = Rules(
    title_patterns=(
        (rf"^(제{WS}*\d+{WS}*[장절]){WS}+(.+)$", 2),
        (rf"^(제{WS}*\d+{WS}*조){WS}*[\(\[]?(.{{2,80}}?)[\)\]]?$", 2),
        (rf"^\d{{1,3}}\.{WS}+(.{{2,100}})$", 1),
        (rf"^[가-힣]\.{WS}+(.{{2,100}})$", 1),
        (r"^(.{2,100}(보통약관|특별약관|실손의료비|배상책임|휴대품손해|수하물|항공기|지연|결항|구조송환|여행중단|여행취소).*)$", 2),
        (r"^(보상하는 손해|보상하지 않는 손해|보상하지 아니하는 손해|보험금의 지급사유|보험금을 지급하지 않는 사유|보험금 청구|보험금 지급|용어의 정의)$", 1),
    ),
    noise_words=("목차", "개인정보", "상품요약서", "가입자 유의사항", "주요내용 요약서"),
    excluded=(
        "보상하지 않는 손해", "보상하지 않는 사항", "보상하지 아니하는 손해", "보상하지 아니하는 사항", "보험금을 지급하지 않는",
        "면책사항", "지급하지 않는 사유", "보상하지 않습니다", "보상하지 아니합니다",
    ),
    procedure=("보험금의 청구", "청구서류", "지급절차", "보험금 청구", "서류를 제출"),
    definition=("용어의 정의", "용어 해설", "보험용어"),
)

#: For corpora without such wording: short lines are titles, and frequent words stand for categories.
CORPUS = Rules(
    title_patterns=((r"^.{2,40}$", 0),),
    title_chars=(2, 40),
    keywords=keywords_from(
        {
            "ontion": {"primary_category": "flight_delay", "secondary_category": "baggage"},
            "thanedble": "medical_expense",
            "tiontion": "baggage",
            "queque": "liability",
            "nicht": "trip_cancellation",
            "onbleea": "death_disability",
            "license": "dental_emergency",
            "ing tion": {"primary_category": "emergency_transport"},
        }
    ),
    excluded=("heat", "shth"),
    procedure=("queque", "license"),
    definition=("licht", "aire"),
    preamble="(start)",
)
