"""Alignment of two tokenizers' tokens: groups between common ends, and links.

A is byte-level BPE and reads a space and the text, B is a SentencePiece model, which
adds the space itself. Both leave the same bytes, so tokens are byte ranges. Many
cuts of texts, laid end to end, are aligned at once by numpy: the offsets where both
end part the tokens into groups, and each step of the united ends is one link, of
the two tokens that it lies in. Counts of pairs, and what they give each text, are
Spark's grouping and joins.

Neither vocabulary has a token that goes on over the start of white space (but for
kinds of white space that a piece of B has behind other characters; there is no cut
before these). So a text is cut there, and a part of the table, some PART_BYTES of
texts, is one row: its distinct cuts with their tokens, and its texts as lists of
numbers of cuts. Each distinct cut is aligned once in a part; sums, groups and links
of texts are put together from their cuts'. All steps are linear in the tokens, but
for sorting and searching their ends, so a text without white space is no special case.

A pair's count is the number of documents that hold it linked. Counts are joined to
links by broadcast up to MOST_PAIRS pairs, else by a join on links summed up by text.

Defined cases: null and empty texts, and texts whose tokens' bytes differ from space
and text (say, those that hold U+2581), have no tokens: zeros, and '' for the digest.
Rows that repeat are documents of their own, also in counts; null ids stay null.
Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunk_memory import ChunkMemory, parts_of
from .common import saved, whole_text
from .token_files import SPACES, Encoder

#: Bytes of texts of a part, rows of a part's file, cuts remembered by a worker and their longest; pairs that are broadcast at most (some 100 MB).
PART_BYTES, PARTS_A_FILE, CACHED_CUTS, LONGEST_CUT, MOST_PAIRS = 3_000_000, 4, 400_000, 48, 1_000_000
#: Cuts of one call of the library.
CALL_CUTS = 20_000
#: Thousands of cuts that are aligned at once (one cut at least), which bounds the arrays of that step.
FEW = 64
SPACE, MARK = "▁", "\0"
#: A pair of ids as one number.
FIRST = 1 << 20
PARTS = "part long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, groups_sha256: string, cuts: array<int>>>, links array<array<long>>"


class Side(NamedTuple):
    """A tokenizer's tokens of cuts laid end to end: ids, the byte that each ends at, and how many each cut has."""

    ids: np.ndarray
    ends: np.ndarray
    n: np.ndarray

    def first(self) -> np.ndarray:
        """Each cut's first token, and the number of all."""
        return np.concatenate([[0], np.cumsum(self.n)])

    def slice(self, lo: int, hi: int) -> Side:
        """Of cuts from lo to hi."""
        low, high = self.first()[[lo, hi]]
        return Side(self.ids[low:high], self.ends[low:high], self.n[lo:hi])


class Tokens:
    """Both tokenizers of a worker process."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path)
        self.a.memory = ChunkMemory(CACHED_CUTS, LONGEST_CUT)
        self.a.library.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.pieces.id_to_piece(i) for i in range(len(self.pieces))]
        spelt = [1 if self.pieces.is_byte(i) else 0 if self.pieces.is_control(i) else len(p.replace(SPACE, " ").encode()) for i, p in enumerate(names)]
        self.b_bytes = np.array(spelt, dtype=np.int64)
        self.b = ChunkMemory(CACHED_CUTS, LONGEST_CUT)
        # A's and then B's ids as text: each with a comma after it, and with the sign after the last of a group
        self.names = pa.array([f"{i}{sign}" for n, last in ((len(self.a.n_bytes), "|"), (len(names), ";")) for i in range(n) for sign in (",", last)])
        after = {p[i] for p in names for i in range(1, len(p)) if p[i] != p[i - 1]}  # a cut before these may part a piece
        self.safe = "".join(c for c in SPACES if (SPACE if c == " " else c) not in after)
        self.border = f"([^{SPACES}])([{self.safe}])"
        self.cut = re.compile(f"(?<=[^{SPACES}])(?=[{self.safe}])")

    def cuts(self, texts: pa.StringArray) -> pa.ListArray:
        if not self.safe:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int32()), texts)
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            return pa.array([self.cut.split(x) for x in texts.to_pylist()], pa.list_(pa.string()))
        return pc.split_pattern(pc.replace_substring_regex(texts, self.border, r"\1" + MARK + r"\2"), MARK)

    def b_ids(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cuts: the space that B adds is a cut's own first space, or else goes again."""
        if len(cuts) > CALL_CUTS:
            parts = [self.b_ids(cuts[lo : lo + CALL_CUTS]) for lo in range(0, len(cuts), CALL_CUTS)]
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        own = [c[:1] == " " for c in cuts]
        found = self.pieces.encode([c[1:] if o else c for c, o in zip(cuts, own, strict=True)], num_threads=1)
        lone = [self.pieces.piece_to_id(SPACE)]  # of a space alone, as B adds none to an empty text
        found = [lone if c == " " else f if o else f[1:] for c, f, o in zip(cuts, found, own, strict=True)]
        return np.array([i for f in found for i in f], dtype=np.uint32), np.array([len(f) for f in found], dtype=np.int64)

    def of(self, cuts: pa.StringArray) -> tuple[Side, Side, np.ndarray, np.ndarray]:
        """Tokens of cuts by A and B; whether the bytes of both are those of the cut, else it has none; and the byte that each cut ends at."""
        alone = pa.ListArray.from_arrays(pa.array(np.arange(len(cuts) + 1), pa.int32()), cuts)
        kind = lambda c: not (c and c[0] in SPACES and c[-1] not in SPACES)
        size = pc.binary_length(cuts).to_numpy(zero_copy_only=False).astype(np.int64)
        last, ok, found = np.cumsum(size), np.ones(len(cuts), dtype=bool), []
        for (ids, n), width in (
            (self.a.memory.ids(alone, [self.a.joined, self.a.each], kind), self.a.n_bytes),
            (self.b.ids(alone, [self.b_ids]), self.b_bytes),
        ):
            ends = np.cumsum(width[ids])
            before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
            ok &= np.diff(before) == size
            ends += np.repeat(last - size - before[:-1], n)
            found.append((ids, ends, n))
        kept = [Side(ids[k := np.repeat(ok, n)].astype(np.int64), ends[k], np.where(ok, n, 0)) for ids, ends, n in found]
        return *kept, ok, last

    def groups(self, a: Side, b: Side) -> tuple[pa.StringArray, np.ndarray]:
        """Of each cut: its groups as text, a sign after each, and their number."""
        a_last, b_last = (common(x.ends, y.ends) for x, y in ((a, b), (b, a)))
        a_group, b_group = (np.cumsum(x) - x for x in (a_last, b_last))
        a_before, b_before = (np.concatenate([[0], np.flatnonzero(x) + 1]) for x in (a_last, b_last))  # tokens before each group
        code = np.empty(len(a.ids) + len(b.ids), dtype=np.int64)
        code[np.arange(len(a.ids)) + b_before[a_group]] = 2 * a.ids + a_last
        code[np.arange(len(b.ids)) + a_before[b_group + 1]] = 2 * (len(self.a.n_bytes) + b.ids) + b_last
        texts = pa.ListArray.from_arrays(pa.array(a.first() + b.first(), pa.int32()), self.names.take(pa.array(code)))
        return pc.binary_join(texts, ""), np.diff(np.concatenate([[0], np.cumsum(a_last)])[a.first()])


def common(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each of the ascending ends is one of the ascending others."""
    return np.concatenate([others, [-1]])[np.searchsorted(others, ends)] == ends


def links(a: Side, b: Side, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ids of cuts' links, one cut after the other, and the number of each one's. last: the byte that each cut ends at."""
    steps = np.union1d(a.ends, b.ends)
    pairs = a.ids[np.searchsorted(a.ends, steps)] * FIRST + b.ids[np.searchsorted(b.ends, steps)]
    return pairs, np.diff(np.searchsorted(steps, last, side="right"), prepend=0)


def aligned(both: Tokens, a: Side, b: Side, last: np.ndarray, step: int) -> tuple[pa.StringArray, np.ndarray, pa.ListArray]:
    """Of each cut: its groups as text, their number, and its links' pairs; `step` cuts at once."""
    texts, n_groups, pairs, n_links = [], [], [], []
    for lo in range(0, len(last), step):
        hi = min(lo + step, len(last))
        of = a.slice(lo, hi), b.slice(lo, hi)
        for held, x in zip((texts, n_groups, pairs, n_links), (*both.groups(*of), *links(*of, last[lo:hi])), strict=True):
            held.append(x)
    ends = np.concatenate([[0], np.cumsum(np.concatenate(n_links))])
    return pa.concat_arrays(texts), np.concatenate(n_groups), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(pairs)))


_tokens: dict[tuple[str, str], Tokens] = {}


def tokens(a_path: str, b_path: str) -> Tokens:
    """One for each worker process, kept between its tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (a_path, b_path) not in _tokens:
        _tokens[a_path, b_path] = Tokens(a_path, b_path)
    return _tokens[a_path, b_path]


def aligned_parts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """part, docs (doc_id, n_a, n_b, n_groups, groups_sha256, the numbers of its cuts), links (the pairs of each distinct cut). Texts without tokens have no cuts."""

    def one(list_of: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(list_of)], pa.int32()), list_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part, step = tokens(a_path, b_path), TaskContext.get().partitionId() << 32, max(1, FEW << 10)
        for rows in parts_of(batches, PART_BYTES):
            texts, ids = (rows.column(c).combine_chunks() for c in ("text", "doc_id"))
            texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
            lists = both.cuts(pc.binary_join_element_wise(" ", texts, ""))
            encoded = lists.flatten().dictionary_encode()
            number = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            a, b, ok, last = both.of(encoded.dictionary)
            groups, n_groups, pairs = aligned(both, a, b, last, step)
            of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            bad = np.bincount(of, weights=~ok[number], minlength=len(lists)) > 0
            bad |= pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            total = [np.where(bad, 0, np.bincount(of, weights=n[number], minlength=len(lists))).astype(np.int64) for n in (a.n, b.n, n_groups)]
            keep = ~bad[of]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=len(lists)))]), pa.int32())
            own = number[keep].astype(np.int32)
            whole = pc.binary_join(pa.ListArray.from_arrays(ends, groups.take(pa.array(own))), "").cast(pa.binary())
            digest = pa.array([hashlib.sha256(x[:-1]).hexdigest() if x else "" for x in whole.to_pylist()], pa.string())
            held = pa.ListArray.from_arrays(ends, pa.array(own))
            fields = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "cuts"]
            told = pa.StructArray.from_arrays([ids.cast(pa.int64()), *map(pa.array, total), digest, held], fields)
            yield pa.RecordBatch.from_arrays([pa.array([part]), one(told), one(pairs)], ["part", "docs", "links"])
            part += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, PARTS)


def links_of(cuts: Column) -> Column:
    """The pairs of a text's cuts, one after the other."""
    return F.flatten(F.transform(cuts, lambda i: F.get(F.col("links"), i)))


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, value): twice the number of documents that hold a pair linked, and 1 more if it is its A id's highest."""
    each = parts.select(F.explode(F.transform("docs", lambda d: F.array_distinct(links_of(F.array_distinct(d["cuts"]))))).alias("pairs"))
    counts = saved(each.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    first = F.floor(F.col("pair") / FIRST).alias("first")
    highest = counts.groupBy(first).agg(F.max("n").alias("most"))
    marked = counts.withColumn("first", F.floor(F.col("pair") / FIRST)).join(highest, "first")
    return saved(marked.select("pair", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("value")), "pair-values")


def link_sums(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(part, at, n_links, n_best, count_sum) of each text that has links."""
    texts = parts.select("part", F.posexplode(F.transform("docs", lambda d: links_of(d["cuts"]))).alias("at", "pairs"))
    links = texts.select("part", "at", F.explode("pairs").alias("pair"))
    if counts.count() <= MOST_PAIRS:
        found, times = links.join(F.broadcast(counts), "pair"), F.lit(1)
    else:
        found, times = links.groupBy("part", "at", "pair").agg(F.count("*").alias("times")).join(counts, "pair"), F.col("times")
    value = F.col("value")
    return found.groupBy("part", "at").agg(
        F.sum(times).cast("long").alias("n_links"), F.sum(times * (value % 2)).alias("n_best"), F.sum(times * F.shiftright(value, 1)).alias("count_sum")
    )


def alignment_report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document (doc_id, text)."""
    parts = saved(aligned_parts(docs, a_path, b_path), "aligned", maxRecordsPerFile=str(PARTS_A_FILE))
    rows = parts.select("part", F.posexplode("docs").alias("at", "d")).select("part", "at", "d.doc_id", "d.n_a", "d.n_b", "d.n_groups", "d.groups_sha256")
    sums = link_sums(parts, pair_counts(parts))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(sums, ["part", "at"], "left").select("doc_id", "n_a", "n_b", "n_groups", *map(none, ("n_links", "n_best", "count_sum")), "groups_sha256")
