"""Alignment against a plain version that encodes whole texts and compares all pairs of tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from lamina.llm import token_alignment as T
from lamina.llm.common import ready
from lamina.llm.queries import BYTE_BPE, PIECES

SCHEMA = "doc_id long, text string, cuts string, links string"


def byte_of_characters():
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_library = Tokenizer.from_file(BYTE_BPE)
    a_library.encode_special_tokens = True
    b_library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    names, byte_of = {i: p for p, i in a_library.get_vocab().items()}, byte_of_characters()

    def piece(i):
        p = b_library.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_library.is_byte(i) else p.replace("▁", " ").encode()

    held, docs = [], Counter()
    for doc, text, *_ in rows:
        a = a_library.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_library.encode(text) if text else []
        a_bytes, b_bytes = [bytes(byte_of[c] for c in names[i]) for i in a], [piece(i) for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            held.append((doc, [], [], [], 0, ""))
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at, found = 0, []
            for x in parts:
                found.append((at, at + len(x)))
                at += len(x)
            spans.append(found)
        starts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for end in starts:
            groups.append("|".join(",".join(str(i) for i, (x, y) in zip(ids, s, strict=True) if low <= x and y <= end) for ids, s in ((a, spans[0]), (b, spans[1]))))
            low = end
        links = [(i, j) for i, (x, y) in zip(a, spans[0], strict=True) for j, (u, v) in zip(b, spans[1], strict=True) if x < v and u < y]
        docs.update(set(links))
        held.append((doc, a, b, links, len(starts), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (i, _), n in docs.items():
        most[i] = max(most[i], n)
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(((d, len(a), len(b), n, len(links), sum(docs[x] == most[x[0]] for x in links), sum(docs[x] for x in links), sha) for d, a, b, links, n, sha in held), key=key)


def texts():
    rng = random.Random(5)
    parts = ["the", "tion", "ä", "é", "한국", "日本語", "🙂", "👩‍👧", "'s", "don't", "1234", "...", ";", "\r", "\n", "\t", "  ", " ", "　", "\xa0", " ", "<|endoftext|>", "</s>", "{", "}", "\\", "é", "Zx", "_" * 9, "▁"]
    weights = [6] * (len(parts) - 1) + [0.2]
    out = ["".join(rng.choices(parts, weights)[0] for _ in range(rng.randint(1, 40))) for _ in range(250)]
    out += ["a b\0c d", "\0", " ", "  ", "\n", " x", "x ", "▁", "a;\r\nb", "}\r", "<0x0A>", "<s> a", "plain words in a row", "plain words in a row"]
    return out + ["word" * 400, "ab\n" * 300]


@pytest.mark.parametrize(("part_bytes", "most_pairs", "few"), [(3_000_000, 1_000_000, 64), (500, 0, 0)])
def test_matches_plain_version(spark, monkeypatch, part_bytes, most_pairs, few):
    monkeypatch.setattr(T, "FEW", few)
    monkeypatch.setattr(T, "PART_BYTES", part_bytes)
    monkeypatch.setattr(T, "MOST_PAIRS", most_pairs)
    rows = [(i, t, "", "") for i, t in enumerate(texts())] + [(1, None, "", ""), (2, "", "", ""), (None, "the same", "", ""), (9, "the same", "", ""), (9, "the same", "", "")]
    got = T.alignment_report(ready(spark).createDataFrame(rows, SCHEMA), BYTE_BPE, PIECES).collect()
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in got), key=key) == plain(rows)


def test_empty_table(spark):
    df = ready(spark).createDataFrame([], SCHEMA)
    assert T.alignment_report(df, BYTE_BPE, PIECES).collect() == []


def test_only_white_space_that_no_piece_has_inside_is_cut():
    both = T.tokens(BYTE_BPE, PIECES)
    assert " " in both.safe and "\n" in both.safe and "\r" not in both.safe


def test_no_lambda_is_interpreted_for_each_token(spark):
    df = ready(spark).createDataFrame([(1, "plain words in a row", "", "")], SCHEMA)
    assert "lambda" not in T.aligned_parts(df, BYTE_BPE, PIECES)._jdf.queryExecution().toString()


@pytest.mark.parametrize("step", [1, 2, 100])
def test_cuts_laid_end_to_end_keep_their_own_groups_and_links(step):
    import pyarrow as pa

    both = T.tokens(BYTE_BPE, PIECES)
    rows = [" the", "\r▁", " unbelievably", "\n日本語", " the", " tion" * 3]
    a, b, ok, last = both.of(pa.array(rows))
    assert ok.tolist() == [r != "\r▁" for r in rows]
    groups, n_groups, links = T.aligned(both, a, b, last, step)
    for k, text in enumerate(rows):
        if not ok[k]:
            assert (groups[k].as_py(), n_groups[k], links[k].as_py()) == ("", 0, [])
        elif text[0] == " ":
            (_, _, _, n, n_links, *_, digest), = plain([(k, text[1:])])
            assert (n_groups[k], len(links[k]), hashlib.sha256(groups[k].as_py()[:-1].encode()).hexdigest()) == (n, n_links, digest)
