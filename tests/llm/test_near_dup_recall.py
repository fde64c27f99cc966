"""The share of pairs at the threshold that the pipeline's near-dedup finds, measured on generated pairs."""

import random

import numpy as np
from lamina.llm import simhash_dedup as S
from lamina.llm.common import ready

LOW, HIGH, PAIRS = 0.80, 0.85, 1500


def grams(words):
    return set(zip(*[words[i:] for i in range(5)], strict=False))


def near_pairs(rng, n):
    """n pairs of texts whose similarity lies from LOW to HIGH: some words of a text replaced, here and there."""
    vocabulary = [f"w{i}" for i in range(5000)]
    out = []
    while len(out) < n:
        words = rng.choices(vocabulary, k=rng.randint(60, 400))
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.015, 0.025)))):
            other[at] = rng.choice(vocabulary)
        a, b = grams(words), grams(other)
        if LOW <= len(a & b) / len(a | b) < HIGH:
            out.append((" ".join(words), " ".join(other)))
    return out


def test_search_by_votes_misses_under_one_pair_in_a_hundred():
    pairs = near_pairs(random.Random(11), PAIRS)
    votes = [np.array([S.votes_of(S.gram_hashes(t, 5)) for t in side]).view(np.uint64) for side in zip(*pairs, strict=True)]
    apart = np.bitwise_count(votes[0] ^ votes[1]).sum(axis=1)
    recall = float((apart <= S.RADIUS).mean())
    print(f"{recall:.4f} of {PAIRS} pairs at {LOW} to {HIGH}; {apart.mean():.1f} bits apart on average, {apart.max()} at most")
    assert recall >= 0.99


def test_stage_keeps_one_text_of_each_pair(spark):
    pairs = near_pairs(random.Random(12), 400)
    rows = [(2 * i + side, text, "en", "s", len(text)) for i, pair in enumerate(pairs) for side, text in enumerate(pair)]
    docs = ready(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = {r.doc_id for r in S.one_of_similar(docs).collect()}
    assert {2 * i for i in range(len(pairs))} <= kept
    missed = sum(2 * i + 1 in kept for i in range(len(pairs)))
    assert missed <= 0.01 * len(pairs)
