"""Toxicity scores from a factorization machine over hashed terms.

Terms are a text's distinct words (lower case, without punctuation at the ends)
and their five-letter beginnings, hashed. The machine adds to the linear weights
the inner products of the factors of each pair of terms that occur together, so
that, say, an insult counts for more beside the mention of a group.

It is trained on about SAMPLE labelled documents, chosen by hash of doc_id, whose
ids and labels are the only thing broadcast (rows that repeat one of these ids are fitted too:
4 * SAMPLE rows at most). Of their terms those are kept whose chi-squared statistic against the label is CHI or more (the
largest TERMS of them), so long texts don't drown in words that tell nothing. Terms are counted by Spark; only the kept
ones of each text go to the one task that fits.
Every whole text is then scored.

Defined cases: null and empty texts: the score of a text without terms. Null
doc_id: not held out. Labels of one doc_id that disagree: toxic. Null labels are
not used. Without labels, or with one class only, that class's share is the
score. Repeated rows each get their row. Empty table: empty result. Other
columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, saved, whole_text

BITS = 20
SAMPLE, TERMS, CHI = 20_000, 4096, 12.0
FACTORS, EPOCHS, BATCH, RATE, SHRINK = 8, 15, 256, 0.1, 1e-4
#: Words whose terms a worker keeps at most.
CACHED_WORDS = 500_000
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…“”‘’«»¿¡"

_known: dict[str, tuple[int, ...]] = {}


def _terms_of_word(word: str) -> tuple[int, ...]:
    bare = word.strip(EDGES)
    if not bare:
        return ()
    of = lambda x: xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
    return (of(bare), of("^" + bare[:5])) if len(bare) > 5 else (of(bare),)


def terms(text: str) -> np.ndarray:
    """Distinct hashed terms of a text, sorted."""
    if len(_known) > CACHED_WORDS:
        _known.clear()
    words = set(text.lower().split())
    for word in words.difference(_known):
        _known[word] = _terms_of_word(word)
    found = {t for word in words for t in _known[word]}
    return np.fromiter(found, dtype=np.uint32, count=len(found))


class Machine:
    """score = sigmoid(bias + sum of w + sum over pairs of v.v), for the kept terms of a text."""

    def __init__(self, kept: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.kept, self.bias, self.w, self.v = kept, bias, w, v
        self.at = np.full(1 << BITS, -1, dtype=np.int32)
        self.at[kept] = np.arange(len(kept))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, kept=self.kept, bias=np.array(self.bias), w=self.w, v=self.v)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Machine:
        x = np.load(io.BytesIO(data), allow_pickle=False)
        return Machine(x["kept"], float(x["bias"]), x["w"], x["v"])

    def margin(self, found: np.ndarray) -> float:
        at = self.at[found]
        at = at[at >= 0]
        if not len(at):
            return self.bias
        v = self.v[at]
        total = v.sum(axis=0)
        return self.bias + float(self.w[at].sum()) + 0.5 * float((total * total).sum() - (v * v).sum())


def kept_terms(seen: np.ndarray, positive: np.ndarray, rows: int, positives: int) -> np.ndarray:
    """Of terms the sorted ones to keep, from the numbers of rows that hold them, and of those of label 1."""
    often = positive + seen >= 3
    terms, a, b = np.flatnonzero(often), positive[often].astype(float), (seen - positive)[often].astype(float)
    c, d = positives - a, rows - positives - b
    chi = rows * (a * d - b * c) ** 2 / np.maximum(1.0, (a + b) * (c + d) * (a + c) * (b + d))
    order = np.argsort(-chi, kind="stable")[:TERMS]
    return np.sort(terms[order[chi[order] >= CHI]])


def fit(rows: list[np.ndarray], labels: np.ndarray, kept: np.ndarray | None = None) -> Machine:
    """Stochastic gradient descent with per-weight rates (AdaGrad) on the logistic loss; the same rows give the same machine."""
    n, positive = len(rows), int(labels.sum())
    share = (positive + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    if not positive or positive == n:
        return Machine(np.zeros(0, dtype=np.int64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    if kept is None:
        count = lambda which: np.bincount(np.concatenate([rows[i] for i in which] or [[]]).astype(np.int64), minlength=1 << BITS)
        kept = kept_terms(count(range(n)), count(np.flatnonzero(labels == 1)), n, positive)
    rng = np.random.default_rng(7)
    machine = Machine(kept, bias, np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS)))
    held = [machine.at[r] for r in rows]
    held = [x[x >= 0] for x in held]
    w, v = machine.w, machine.v
    gw, gv, gb = np.full(len(w), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        shuffled = rng.permutation(n)
        for lo in range(0, n, BATCH):
            batch = shuffled[lo : lo + BATCH]
            sizes = np.array([len(held[i]) for i in batch])
            at = np.concatenate([held[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), sizes)
            total = np.zeros((len(batch), FACTORS))
            np.add.at(total, row, v[at])
            square = np.bincount(row, weights=(v[at] ** 2).sum(axis=1), minlength=len(batch))
            margin = machine.bias + np.bincount(row, weights=w[at], minlength=len(batch)) + 0.5 * ((total**2).sum(axis=1) - square)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[batch]) / len(batch)
            slope_w = np.bincount(at, weights=error[row], minlength=len(w)) + SHRINK * w
            slope_v = np.zeros_like(v)
            np.add.at(slope_v, at, error[row, None] * (total[row] - v[at]))
            slope_v += SHRINK * v
            gw += slope_w**2
            gv += slope_v**2
            gb += error.sum() ** 2
            w -= RATE * slope_w / np.sqrt(gw)
            v -= RATE * slope_v / np.sqrt(gv)
            machine.bias -= RATE * error.sum() / np.sqrt(gb)
    return machine


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> bytes:
    """A machine from labelled rows outside the held-out fold."""
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    by_id = told.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").cast("int").alias("label"))
    sample = hash_sample(by_id, ["labelled"], SAMPLE).limit(2 * SAMPLE)
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"))  # 2 * SAMPLE rows of two numbers at most

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "terms": [np.sort(terms(x)).astype(np.int32) for x in pdf["text"]]})

    found = saved(texts.select("label", "text").mapInPandas(hashed, "label int, terms array<int>"), "terms")
    rows, positives = found.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counted = found.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("positive"))
    counts = counted.where("n >= 3").toArrow()  # 2**BITS rows of three numbers at most
    seen, positive = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
    seen[counts["term"].to_numpy()], positive[counts["term"].to_numpy()] = counts["n"].to_numpy(), counts["positive"].to_numpy()
    kept = kept_terms(seen, positive, rows, positives)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "terms": [np.intersect1d(x, kept).astype(np.uint32).tobytes() for x in pdf["terms"]]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame(columns=["label", "terms"])]).sort_values(["label", "terms"])
        machine = fit([np.frombuffer(x, dtype=np.uint32) for x in rows["terms"]], rows["label"].to_numpy(dtype=float), kept)
        yield pd.DataFrame({"model": [machine.dump()]})

    few = found.mapInPandas(reduced, "label int, terms binary").limit(4 * SAMPLE).repartition(1)  # TERMS numbers of each row at most
    models = few.mapInPandas(learn, "model binary").collect()
    return bytes(models[0]["model"]) if models else fit([], np.zeros(0)).dump()


def scored(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, score of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.load(model)
        for batch in batches:
            margins = np.array([machine.margin(terms(x)) for x in batch.column("text").to_pylist()], dtype=float)
            scores = 1 / (1 + np.exp(-np.clip(margins, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    return scored(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
