"""Coding round trips, damage, and ids against the library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lamina.llm import token_files as T
from lamina.llm.common import ready
from lamina.llm.queries import BYTE_BPE
from tokenizers import Tokenizer

PATH = BYTE_BPE
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = st.lists(st.one_of(st.sampled_from(["\0", " ", "  ", "\t", "\n", " \n ", "the", "'s", "é", "\x85", "\x1c", "　", "12", "!?", "<|endoftext|>", "日本", "😀"]), st.text(max_size=3)), max_size=14).map("".join)


@settings(max_examples=500, deadline=None)
@given(TEXTS.filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
def test_ids_of_chunks_are_the_librarys(text):
    got = T.encoder(PATH).encode(pa.array([text]))[0].tolist()
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 1 << 16, (1 << 16) + 1, 300_000])
@pytest.mark.parametrize("kind", ["one", "skewed", "flat"])
def test_segments_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"one": np.full(n, 7), "skewed": np.minimum(rng.geometric(0.02, n), 50_000), "flat": rng.integers(0, 50_257, n)}[kind].astype(np.uint32)
    data = T.encode_segment(ids)
    assert (T.decode_segment(data) == ids).all()
    if n == 300_000:
        share = np.unique(ids, return_counts=True)[1] / n
        entropy = float(-(share * np.log2(share)).sum())
        assert len(data) * 8 / n < 1.05 * entropy + 64 * 64 * 4 * 5 / n + 64 * len(share) / n + 0.3


def test_damage_is_found():
    ids = np.random.default_rng(1).integers(0, 900, 70_000).astype(np.uint32)
    data = bytearray(T.encode_segment(ids))
    data[len(data) * 3 // 4] ^= 1
    with pytest.raises(ValueError):
        T.decode_segment(bytes(data))


def test_documents_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(T, "BUCKET_ROWS", 20)
    monkeypatch.setattr(T, "SEGMENT_IDS", 400)
    rng = random.Random(2)
    rows = [(i * 3, " ".join(rng.choices(["the", "a  b", "x\n", "é", "tion"], k=rng.randint(0, 60))), "x", 1) for i in range(150)]
    rows += [(7, None, "x", 1), (8, "", "x", 1), (100_000, "z" * 30_000, "x", 1), (None, "first", "x", 1), (9, "same", "x", 1), (9, "same", "x", 1)]
    rng.shuffle(rows)
    docs = ready(spark).createDataFrame(rows, "doc_id long, text string, data string, bucket int")
    segments = T.write_segments(docs, PATH, end_id=2)
    assert segments.count() > 5
    got = sorted(T.read_documents(segments).collect(), key=lambda r: r.start)
    at = 0
    for (doc_id, text, *_), r in zip(sorted(rows, key=lambda r: (r[0] if r[0] is not None else -1, r[1] or "")), got, strict=True):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert T.read_documents(T.write_segments(docs.limit(0), PATH, end_id=2)).collect() == []


def test_memory_that_forgets(monkeypatch):
    """Ids stay the library's whatever is forgotten in between."""
    monkeypatch.setattr(T, "CACHED_CHUNKS", 40)
    monkeypatch.setattr(T, "CALL_CHUNKS", 7)
    monkeypatch.setattr(T, "JOINED_CHUNKS", 3)
    rng, of = random.Random(4), T.Encoder(PATH)
    for n in range(60):
        texts = [None or " ".join(rng.choices([f"w{i}" for i in range(90)] + ["the", "", "\n", "é\t", "x" * 60, "\0a"], k=rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        ids, counts = of.encode(pa.array(texts, pa.string()))
        want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert len(of.memory.known) <= 40 + 90
