"""The pipeline's stages on a small table, each against a brute-force version of its decisions."""

import re

import corpus_pipeline as P
import numpy as np
import sentencepiece
from lamina.llm import quality as Q
from lamina.llm import secret_scan as S
from lamina.llm.common import ready, saved
from test_simhash_dedup import similar_classes
from test_source_mix import brute_targets


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs]
    for name, stage in P.STAGES:
        seen.append(saved(stage(spark, seen[-1], d), name))
    for after in seen[1:-1]:
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
    start, good, single, clean, mixed, last = ({r.doc_id: r for r in x.collect()} for x in seen)

    patterns = {i: Q.votes(r.text, r.text.split()) for i, r in start.items()}
    counts = {p: list(patterns.values()).count(p) for p in set(patterns.values())}
    likely = Q.posteriors(counts)
    agree = np.mean([(likely[patterns[i]] >= 0.5) == (i in good) for i in start])
    assert agree > 0.97 and set(good) < set(start) and all(good[i] == start[i] for i in good)

    ids = sorted(good)
    want = {ids[i] for i in set(similar_classes([good[i].text for i in ids]))}
    assert set(single) == want and len(single) < len(good)

    assert set(clean) == set(single)
    for i, r in clean.items():
        redone = [m for _, p, group, least in S.KINDS for m in re.finditer(p.replace("(?i:", "(?:"), r.text, re.I if group else 0) if len(m[group]) >= least]
        assert not redone and (r.text == single[i].text or "[SECRET]" in r.text) and r.n_chars == len(r.text)

    size = lambda t: len(t.split())
    sizes, taken = {}, {}
    for r in clean.values():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    for r in seen[4].collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in brute_targets(sizes).items()) and set(mixed) <= set(clean)

    library = sentencepiece.SentencePieceProcessor(model_file=P.PIECES)
    texts = sorted((r.doc_id, r.text) for r in seen[4].collect())
    want = sorted((i, library.encode(t)) for i, t in texts)
    assert sorted((r.doc_id, list(r.ids)) for r in seen[5].collect()) == want and all(r.exact for r in last.values())
    assert P.run(spark, d).count() == len(want)


def test_null_and_repeated_ids_and_no_rows(spark):
    """Stages keep a row for each class whatever ids rows share, and take a table without rows."""
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    big = (1 << 60) + 1
    words = "the cat sat on the mat and looked at the dog that came in from the garden to sleep by the fire".split()
    unlike = [" ".join(words[i:] + words[:i]) + f". It was number{i} of them, she said; then they left." for i in range(8)]
    ids = [None, None, big, big, 7, 7, None, 3]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, unlike, strict=True)] + [(None, unlike[0], "en", "s", 1), (5, None, "en", "s", 0), (None, "", None, None, None)]
    docs = ready(spark).createDataFrame(rows, schema)
    kept = P.drop_near_duplicates(spark, docs, "")
    one = {i for i in similar_classes([r[1] for r in rows])}
    assert kept.count() == len(one) and {r.text or "" for r in kept.collect()} == {rows[i][1] or "" for i in one}
    for start in (docs, docs.limit(0)):
        seen = start
        for name, stage in P.STAGES:
            seen = saved(stage(spark, seen, ""), name)
        assert (seen.count() > 0) == (start is docs)
        assert big in {r.doc_id for r in seen.collect()} or start is not docs
