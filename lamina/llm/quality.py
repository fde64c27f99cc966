"""Quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on each text. How often each
pattern of votes occurs is counted over all documents, and
expectation-maximisation over those counts estimates each labeller's accuracy
on good texts and on each kind of bad ones, and so the posterior of each pattern. The posteriors of
about SAMPLE documents, chosen by hash of doc_id and terms, train a logistic scorer over
hashed shapes of words, which then scores every whole text.

No given label is used.

Defined cases: null, empty and white-space texts get no votes, have no terms,
and score the bias. Repeated rows each get their row. Without any row the scorer
says 0.5, which is good. Empty table: empty result. Filtering keeps all columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, saved, whole_text

BUCKETS, SAMPLE = 1024, 6000
ROUNDS, STEPS, RATE, SHRINK = 200, 600, 0.5, 1e-5
CACHED_WORDS = 400_000

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it was on are as with at by this be from or an have not which "
    "le la les de des du et en un une que qui dans pour par sur est au avec "
    "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch es "
    "el los las y que se del un por con una su para al lo como más no".split()
)
SYMBOLS = "|#$%&*^~<>{}[]=\\"
GOOD, BAD, NONE, LABELLERS = "1", "0", "-", 10
#: Neither letters and digits nor the punctuation of prose.
NOT_PLAIN = re.compile(r"[^\w\s.,;:!?'\"()\-/]")


def votes(text: str, words: list[str]) -> str:
    """One character for each labeller."""
    n = len(words)
    if not n:
        return NONE * LABELLERS
    symbols = sum(map(text.count, SYMBOLS)) / n
    marked = sum(w[-1] in SYMBOLS for w in words) / n
    odd = len(NOT_PLAIN.findall(text)) / n
    same = sum(map(eq, words, words[1:])) / n
    capitals = sum(map(str.isupper, words)) / n
    distinct = len(set(words)) / n
    function = sum(map(FUNCTION_WORDS.__contains__, words)) / n
    shout = (text.count("!") + text.count("?")) / n
    stops = (text.count(".") + text.count("!") + text.count("?")) / n
    lines = text.split("\n")
    say = lambda bad, good: BAD if bad else GOOD if good else NONE
    return "".join(
        (
            say(symbols > 0.3, symbols < 0.05),
            say(marked > 0.2, marked < 0.05),
            say(odd > 0.3, odd < 0.05),
            say(same > 0.2, same < 0.03),
            say(capitals > 0.5, capitals < 0.2),
            say(n >= 30 and distinct < 0.15 + 3 / n, n >= 30 and distinct > 0.35),
            say(n >= 20 and function < 0.03, function > 0.12),
            say(shout > 0.3, shout < 0.05),
            say(n >= 30 and stops < 0.01, 0.02 < stops < 0.3),
            say(len(lines) > 5 and len(set(lines)) < 0.5 * len(lines), len(lines) > 3 and len(set(lines)) > 0.9 * len(lines)),
        )
    )


_runs = re.compile(r"(.)\1+", re.DOTALL)


class _Shape(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c
        return out


_shape, _known = _Shape(), {}


def _bucket(word: str) -> int:
    shape = _runs.sub(r"\1", word.translate(_shape)) if word.lower() not in FUNCTION_WORDS else "f"
    return xxhash.xxh32_intdigest(shape.encode("utf-8", "surrogatepass")) % (BUCKETS - 2) + 2


def term_shares(words: list[str]) -> np.ndarray:
    """Root of the share of words in each bucket; bucket 0: words that repeat the one before, 1: unused."""
    if not words:
        return np.zeros(BUCKETS, dtype=np.float32)
    if len(_known) > CACHED_WORDS:
        _known.clear()
    for word in set(words).difference(_known):
        _known[word] = _bucket(word)
    found = np.bincount(np.array(list(map(_known.__getitem__, words))), minlength=BUCKETS)
    found[0] = sum(map(eq, words, words[1:]))
    return np.sqrt(found / len(words)).astype(np.float32)


def posteriors(patterns: dict[str, int]) -> dict[str, float]:
    """Probability that a text with each pattern of votes is good.

    Latent classes: good texts, and a kind of bad ones for each labeller, since
    bad texts are bad in different ways. Labellers are independent within a
    class, and no vote says nothing. Two bad votes start a pattern as bad, one
    leaves it good; expectation-maximisation goes on from there.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    weight = np.array([patterns[k] for k in keys], dtype=float)[:, None]
    seen = np.array([[[v == k for k in (BAD, GOOD)] for v in pattern] for pattern in keys], dtype=float)
    bad = seen[:, :, 0]
    n_bad = bad.sum(axis=1, keepdims=True)
    good = np.where(n_bad == 0, 1.0, np.where(n_bad == 1, 0.9, 0.1))
    share = np.hstack([good, (1 - good) * bad / np.maximum(1, n_bad)])
    for _ in range(ROUNDS):
        votes_of = np.einsum("nc,nlv->clv", weight * share, seen) + 0.1
        log_votes = np.log(votes_of / votes_of.sum(axis=2, keepdims=True))
        logs = np.log((weight * share).sum(axis=0) + 1e-3) + np.einsum("nlv,clv->nc", seen, log_votes)
        new = np.exp(logs - logs.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - share).max() < 1e-9:
            break
        share = new
    return dict(zip(keys, share[:, 0].tolist(), strict=True))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights (the last is the bias) by AdaGrad steps over all rows."""
    w = np.zeros(x.shape[1] + 1)
    squares = np.full(len(w), 1e-6)
    for _ in range(STEPS if len(x) else 0):
        error = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) - y
        slope = np.concatenate([error @ x, [error.sum()]]) / len(x) + SHRINK * w
        squares += slope**2
        w -= RATE * slope / np.sqrt(squares)
    return w


def voted(docs: DataFrame) -> DataFrame:
    """doc_id, pattern, terms (sparse shares: 16-bit buckets, then 32-bit floats) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("pattern", pa.string()), ("terms", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns, sparse = [], []
            for text in batch.column("text").to_pylist():
                words = text.split()
                patterns.append(votes(text, words))
                shares = term_shares(words)
                at = np.flatnonzero(shares).astype("<u2")
                sparse.append(at.tobytes() + shares[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(patterns, pa.string()), pa.array(sparse, pa.binary())], schema=schema)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return kept.mapInArrow(run, "doc_id long, pattern string, terms binary")


def dense(sparse: bytes) -> np.ndarray:
    n = len(sparse) // 6
    out = np.zeros(BUCKETS, dtype=np.float32)
    out[np.frombuffer(sparse, dtype="<u2", count=n)] = np.frombuffer(sparse, dtype="<f4", offset=2 * n)
    return out


def train(seen: DataFrame) -> np.ndarray:
    """Weights of the scorer from a table of votes and terms."""
    counts = {r["pattern"]: r["count"] for r in seen.groupBy("pattern").count().collect()}  # 3**LABELLERS at most
    good = posteriors(counts)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame(columns=["pattern", "terms"])]).sort_values(["pattern", "terms"])
        x = np.array([dense(t) for t in rows["terms"]], dtype=np.float64).reshape(-1, BUCKETS)
        yield pd.DataFrame({"w": [fit(x, np.array([good[p] for p in rows["pattern"]])).tolist()]})

    sample = hash_sample(seen, ["doc_id", "terms"], SAMPLE).limit(2 * SAMPLE)
    models = sample.select("pattern", "terms").repartition(1).mapInPandas(learn, "w array<double>").collect()  # of the sample
    return np.array(models[0]["w"]) if models else np.zeros(BUCKETS + 1)


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, votes, score, keep (score of 0.5 or more) of each row."""
    seen = saved(voted(docs), "votes")
    w = train(seen)

    schema = pa.schema([("doc_id", pa.int64()), ("votes", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = np.array([float(dense(t) @ w[:-1] + w[-1]) for t in batch.column("terms").to_pylist()], dtype=float)
            scores = 1 / (1 + np.exp(-np.clip(margins, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pattern"), pa.array(scores)], schema=schema)

    scored = seen.mapInArrow(run, "doc_id long, votes string, score double")
    return scored.withColumn("keep", F.col("score") >= 0.5)


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    w = train(saved(voted(docs), "votes"))

    @F.pandas_udf("boolean")
    def keep(text: pd.Series) -> pd.Series:
        return pd.Series([float(term_shares((x or "").split()) @ w[:-1] + w[-1]) >= 0 for x in text], dtype=bool)

    return docs.where(keep(F.col("text")))
