"""Ids against the library, paths against brute force, and round trips."""

import random
import struct

import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from lamina.llm import sentence_pieces as S
from lamina.llm.common import ready
from lamina.llm.queries import PIECES

MODEL = PIECES
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXTS = st.lists(st.one_of(st.sampled_from([" ", "  ", "the", "ing", "tion", "\n", "é", "日本", "😀", "ab", "!", "▁", " " * 17, " " * 40]), st.text(max_size=4)), max_size=12).map("".join)


def ids(text):
    return S.pieces(MODEL).encode(pa.array([text]))[0].tolist()


@settings(max_examples=400, deadline=None)
@given(TEXTS.filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t) and "\0" not in t))
def test_same_ids_as_the_library(text):
    assert ids(text) == LIBRARY.encode(text)
    back = S.pieces(MODEL).decode(np.array(ids(text), dtype="<u4").tobytes())
    assert back == LIBRARY.decode(ids(text))
    if "▁" not in text:
        assert back == text


def test_same_ids_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r.text for r in rows]
    found, counts = S.pieces(MODEL).encode(pa.array(texts))
    want = LIBRARY.encode(texts)
    assert counts.tolist() == [len(x) for x in want] and found.tolist() == [i for x in want for i in x]


def message(pieces, model_type):
    def field(n, kind, body):
        return bytes([n << 3 | kind]) + body

    def sized(n, body):
        assert len(body) < 128
        return field(n, 2, bytes([len(body)]) + body)

    out = b"".join(sized(1, sized(1, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    return out + sized(2, field(3, 0, bytes([model_type]))) + sized(3, field(3, 0, b"\1") + field(4, 0, b"\0"))


def test_unigram_viterbi_against_brute_force():
    rng = random.Random(5)
    vocabulary = {"▁", "a", "b", "c"} | {rng.choice(["▁", ""]) + "".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(60)}
    model = S.Pieces(message([("<unk>", 0.0, S.UNKNOWN), *[(p, -rng.random() * 9 - 1, S.NORMAL) for p in sorted(vocabulary)]], S.UNIGRAM))
    score = {p: model.scores[i] for p, i in model.id_of.items()}
    for _ in range(300):
        text = "▁" + "".join(rng.choices("abc", k=rng.randint(1, 14)))
        best = [0.0] + [None] * len(text)
        for end in range(1, len(text) + 1):
            best[end] = max(best[a] + score[text[a:end]] for a in range(end) if text[a:end] in score and best[a] is not None)
        found = model.best_path(text)
        assert "".join(model.pieces[i] for i in found) == text
        assert abs(sum(model.scores[i] for i in found) - best[-1]) < 1e-4
    assert model.best_path("▁zz") == [model.id_of["▁"], model.unknown, model.unknown]


def test_merging_with_ties_against_brute_force():
    """Priorities that tie: merging takes the leftmost of the best, and so must the paths."""
    rng = random.Random(7)
    for _ in range(25):
        made, order = {"▁", "a", "b"}, []
        while len(order) < 12:
            new = rng.choice(sorted(made)) + rng.choice(sorted(made - {"▁"}))
            if new not in made and "▁" not in new[1:]:
                made.add(new)
                order.append(new)
        vocabulary = [("<unk>", 0.0, S.UNKNOWN), ("▁", -99.0, S.NORMAL), ("a", -99.0, S.NORMAL), ("b", -99.0, S.NORMAL)]
        vocabulary += [(p, float(-(k // 3)), S.NORMAL) for k, p in enumerate(order)]
        model = S.Pieces(message(vocabulary, S.BPE))
        for _ in range(60):
            text = "▁" + "".join(rng.choices("ab", k=rng.randint(0, 9)))
            assert [model.pieces[i] for i in model.best_path(text)] == model.merged(text)


def test_query_and_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a" * 50_000, "x"), (4, "the the  the\n", "x"), (4, "the the  the\n", "x"), (None, "n", "x")]
    docs = ready(spark).createDataFrame(rows, "doc_id long, text string, ids string")
    got = S.round_trip_report(docs, MODEL).collect()
    assert all(r.exact for r in got) and sorted(r.n_ids for r in got)[:2] == [0, 0] and len(got) == 6
    back = S.decoded(S.encoded(docs, MODEL), MODEL)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((d or 0, t or "") for d, t, _ in rows)
    assert S.round_trip_report(docs.limit(0), MODEL).collect() == []
    checked = S.encoded_and_checked(docs, MODEL).collect()
    assert [len(r.ids) for r in checked] == [r.n_ids for r in checked] and all(r.exact for r in checked)
