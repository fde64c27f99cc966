"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from lamina.llm import spelling_variants as V
from lamina.llm.common import ready

SCHEMA = "doc_id long, text string, word string, n long"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= 7
    n = {w: c for w, c in count.items() if c >= 2}
    of, forms = {}, {}
    for w in n:
        of[w] = [x for x in n if near(w, x)]
        best = min(of[w], key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, n[w], len(of[w]), forms[w], n[forms[w]] if forms[w] else None, root))
    return sorted(out)


def corpus(seed, n_docs=300):
    rng = random.Random(seed)
    parts = ["an", "aa", "the", "Ing", "tion", "é", "ÿ", "ou", "a", "re", "stst", "lo"]
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 6))) for _ in range(120)]
    vocabulary += ["abcdefgh", "abcdefgx", "abcdefg", "bcdefgh", "abcdefghi", "aaaaaaa", "aaaaaaaa", "aaaaaaab", "x" * 60, "x" * 61, "x" * 60 + "y", "y" + "x" * 60]
    rows = []
    for i in range(n_docs):
        words = [vocabulary[int(len(vocabulary) * rng.random() ** 3)] for _ in range(rng.randint(0, 60))]
        for k in range(len(words)):
            if rng.random() < 0.2:
                w, at = words[k], rng.randrange(len(words[k]))
                words[k] = rng.choice([w[:at] + w[at + 1 :], w[:at] + "q" + w[at:], w[:at] + "z" + w[at + 1 :]])
        rows.append((i, rng.choice([" ", "-", "1 "]).join(words), "x", 1))
    return rows + [(5, None, "", 0), (None, "abcdefgh abcdefgh Ünübersehbar", "", 0), (7, "", "", 0), rows[3], rows[3]]


@pytest.mark.parametrize(("block", "rows", "pairs"), [(8192, 40_000, 2_000_000), (3, 50, 40)])
def test_matches_brute_force(spark, monkeypatch, block, rows, pairs):
    monkeypatch.setattr(V, "BLOCK_WORDS", block)
    monkeypatch.setattr(V, "MERGED_ROWS", rows)
    monkeypatch.setattr(V, "MERGED_PAIRS", pairs)
    told = corpus(block)
    df = ready(spark).createDataFrame(told, SCHEMA)
    got = sorted(tuple(r) for r in V.variant_groups(df).select("word", "n", "n_near", "form", "form_n", "root").collect())
    want = brute(told)
    assert got == want
    assert sum(r[2] for r in want) > 100 and any(r[3] for r in want)


def test_chains_of_forms_end_at_their_last(spark):
    told = [(i, text, "", 0) for i, text in enumerate(["abcdefghij"] * 2 + ["abcdefghik"] * 25 + ["abcdefghkk"] * 300 + ["abcdefgkkk"] * 3100)]
    df = ready(spark).createDataFrame(told, SCHEMA)
    got = {r["word"]: r for r in V.variant_groups(df).collect()}
    assert sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in got.values()) == brute(told)
    assert got["abcdefghik"]["root"] == "abcdefgkkk"


def test_empty_tables_and_no_words(spark):
    df = ready(spark).createDataFrame([(1, "short words", "", 0), (2, None, "", 0)], SCHEMA)
    assert V.variant_groups(df).collect() == []
    assert V.variant_groups(df.limit(0)).collect() == []


def test_one_edit():
    assert V.one_edit("abc", "abd") and V.one_edit("abc", "abcd") and V.one_edit("abc", "xabc") and V.one_edit("abc", "abbc")
    assert not V.one_edit("abc", "abc") and not V.one_edit("abc", "abcde") and not V.one_edit("abc", "acbx")
