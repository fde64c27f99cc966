"""Spelling variants by a positional q-gram inverted index with a count filter.

Words are runs of letters, at least LEAST_CHARS code points long and counted over
all documents. Two words are near if they differ by one inserted, deleted or
replaced code point. One edit changes at most Q of a word's Q-grams, and moves the
others by at most one place. So near words share a number of positional Q-grams
(the count filter's bound), and, of each one's Q + SHARED rarest ones, at least
SHARED (grams are ordered by their number of words, so that both sides agree).

The inverted index is dealt out by posting list: its keys are gram, place and
length. A word is posted under its three rarest grams, since the rarest one that
two near words share is among these in both; and it asks the lists of its own
length, and of the next length at the same place or one further. In a list's task
the postings of the other rare grams are merged, under the same limits of length
and place, and counted; pairs with fewer than SHARED common rare grams go. What is
left must reach the overlap bound over all grams, and is then verified letter by
letter. The merge sorts the runs of many asking words at once, where a heap would
take one posting at a time. Each pair is kept in one list only, that of the rarest
common gram. Lists of over BLOCK_WORDS words are split, and asked in all parts.

A word's form is a word of at least ten times its count, so chains of forms are as
short as the largest count's number of digits; roots are found by doubling steps.

Defined cases: null texts hold no words; a null doc_id is written as empty where
ids are hashed; rows that repeat count each; texts without words, and empty tables,
give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, whole_text

LEAST_CHARS, LEAST_COUNT, FORM_RATIO = 7, 2, 10
#: Letters of a gram; grams that near words share of the Q + SHARED rarest of each: both have Q + SHARED grams that way.
Q, SHARED = 2, 3
RARE = Q + SHARED
#: Words of a posting list at most before it is split; rows of a merge; pairs of postings merged at once; longest word compared in a matrix.
BLOCK_WORDS, MERGED_ROWS, MERGED_PAIRS, WIDE = 8192, 40_000, 2_000_000, 48
ALONE, SHORTER, SAME, SPLIT = 0, 1, 2, 3
UPPER, LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))
KEY = ["gram", "place", "size"]


def edited_runs(docs: DataFrame) -> DataFrame:
    """word: each run of letters of a text, A-Z as a-z, of which every 31st by a hash of doc_id and run lacks one code point; shorter words left out."""
    run = F.regexp_extract_all(F.translate(whole_text(), UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{LEAST_CHARS},}}"), F.lit(0))
    hashed = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.pmod("h", F.lit(31)) == 0, cut).otherwise(F.col("run"))
    return docs.select("doc_id", F.explode(run).alias("run")).withColumn("h", hashed).select(word.alias("word")).where(F.length("word") >= LEAST_CHARS)


def counted(runs: DataFrame) -> DataFrame:
    """(word, n) of words that occur at least LEAST_COUNT times."""
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def gram_ranks(words: DataFrame) -> np.ndarray:
    """A gram's rank by its number of words, rarest first, at 256 times its first letter plus its second. The 90 letters make 8,100 grams at most."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(Q)))).alias("gram"))
    found = grams.groupBy("gram").count().collect()
    ranks = np.full(1 << 16, 1 << 14, dtype=np.int64)
    for rank, gram in enumerate(sorted((r["count"], r["gram"]) for r in found)):
        first, second = gram[1].encode("latin-1")
        ranks[256 * first + second] = rank
    return ranks


def rarest(words: list[str], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and place of each word's RARE rarest grams, by rank, then place; all words have as many."""
    letters = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.flatnonzero(place < np.repeat(sizes, sizes) - 1)
    rank = ranks[256 * letters[whole] + letters[whole + 1]]
    order = np.lexsort((place[whole], rank, row[whole]))
    starts = np.cumsum(sizes - 1) - (sizes - 1)
    first = order[starts[:, None] + np.arange(RARE)]
    return rank[first], place[whole][first]


def posted(words: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(gram, place, size, role, own, word, n): words under their rarest grams, and where they ask; own: which of the word's rare grams it is."""
    kinds = "gram int, place int, size int, role int, own int, word string, n long"
    n_keys = RARE - SHARED + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            if not texts:
                continue
            rank, place = (x[:, :n_keys].ravel() for x in rarest(texts, ranks))
            row = np.repeat(np.arange(len(texts)), n_keys)
            size = np.array([len(w) for w in texts])[row]
            of = pa.array(np.tile(row, 3))
            columns = [
                np.tile(rank, 3), np.concatenate([place, place, place + 1]), np.concatenate([size, size + 1, size + 1]), np.repeat([ALONE, SHORTER, SHORTER], len(row)),
                np.tile(np.arange(n_keys), 3 * len(texts)),
            ]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c.astype(np.int32)) for c in columns], batch.column("word").take(of), batch.column("n").take(of)], ["gram", "place", "size", "role", "own", "word", "n"]
            )

    return words.select("word", "n").mapInArrow(run, kinds)


def split_lists(rows: DataFrame) -> DataFrame:
    """rows with part: lists of over BLOCK_WORDS words in parts, each asked by all."""
    sizes = rows.where(F.col("role") == ALONE).groupBy(*KEY).count().where(F.col("count") > BLOCK_WORDS)
    if not sizes.limit(1).count():
        return rows.withColumn("part", F.lit(0))
    n_parts = F.ceil(F.col("count") / BLOCK_WORDS).cast("int")
    marked = rows.join(sizes.select(*KEY, n_parts.alias("n_parts")), KEY, "left")
    alone, every = F.col("role") == ALONE, F.sequence(F.lit(0), F.col("n_parts") - 1)
    own = F.struct(F.lit(SPLIT).alias("role"), F.pmod(F.xxhash64("word"), F.col("n_parts")).cast("int").alias("part"))
    asking = F.transform(every, lambda p: F.struct(F.when(alone, F.lit(SAME)).otherwise(F.col("role")).alias("role"), p.alias("part")))
    plain = F.array(F.struct(F.col("role"), F.lit(0).alias("part")))
    dealt = F.when(F.col("n_parts").isNull(), plain).when(alone, F.array_append(asking, own)).otherwise(asking)
    return marked.withColumn("x", F.explode(dealt)).select(*KEY, "own", "word", "n", "x.role", "x.part")


def expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [low, high): which range, and each number in it."""
    counts = high - low
    which = np.repeat(np.arange(len(low)), counts)
    return which, np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - low, counts)


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with one letter replaced or, if longer, inserted."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    at = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return len(b) == len(a) + 1 and a[at:] == b[at + 1 :]


class Merge:
    """Whole posting lists, and the near pairs in them. Rows: unit (which list), role, word, and which of its rare grams the list's is."""

    def __init__(self, unit: np.ndarray, role: np.ndarray, own: np.ndarray, words: list[str], ranks: np.ndarray):
        self.unit, self.role, self.own, self.words = unit, role, own, words
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.rank, self.place = rarest(words, ranks)
        short = [w if len(w) <= WIDE else "" for w in words]
        self.letters = np.frombuffer("".join(w.ljust(WIDE, "\0") for w in short).encode("latin-1"), dtype=np.uint8).reshape(-1, WIDE)

    def keys(self, rows: np.ndarray, shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rows' rare grams after the list's own one: their rows, and keys of list, gram and place."""
        later = np.arange(RARE)[None, :] > self.own[rows][:, None]
        at = np.broadcast_to(rows[:, None], later.shape)[later]
        return at, (self.unit[at] << 40) | (self.rank[rows][later] << 26) | (self.place[rows][later] + shift)

    def pairs(self, asking: np.ndarray, listed: np.ndarray, shifts: tuple[int, ...], ordered: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asking row, listed row) of pairs with SHARED common rare grams, the list's own included."""
        rows, keys = self.keys(listed)
        order = np.argsort(keys, kind="stable")
        rows, keys = rows[order], keys[order]
        asked = [self.keys(asking, s) for s in shifts]
        at, wanted = (np.concatenate([x[i] for x in asked]) for i in (0, 1))
        order = np.argsort(at, kind="stable")
        at, wanted = at[order], wanted[order]
        low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        total = np.cumsum(high - low)
        lo = 0
        while lo < len(at):
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + MERGED_PAIRS, "right"))
            hi = max(hi, lo + 1)
            while hi < len(at) and at[hi] == at[hi - 1]:  # an asking word's postings are merged together
                hi += 1
            which, found = expanded(low[lo:hi], high[lo:hi])
            a, b = at[lo:hi][which], rows[found]
            if ordered:
                a, b = a[a < b], b[a < b]
            codes = np.sort(a * len(self.words) + b, kind="stable")
            first = np.flatnonzero(np.diff(codes, prepend=-1) != 0)
            enough = codes[first[np.diff(first, append=len(codes)) >= SHARED - 1]]
            yield enough // len(self.words), enough % len(self.words)
            lo = hi

    def verified(self, a: np.ndarray, b: np.ndarray, longer: bool) -> np.ndarray:
        """Which pairs share enough grams in place, and are one edit apart; b's words are one longer, or as long."""
        n, wide = self.size[a], self.size[b] <= WIDE
        x, y = self.letters[a], self.letters[b]
        inside = np.arange(WIDE)[None, :] < n[:, None]
        same = (x == y) & inside
        common = same[:, :-1] & same[:, 1:]
        if not longer:
            ok = (common.sum(axis=1) >= self.size[b] - Q + 1 - Q) & (n - same.sum(axis=1) == 1)
        else:
            moved = np.zeros_like(same)
            moved[:, :-1] = (x[:, :-1] == y[:, 1:]) & inside[:, :-1]
            common |= moved[:, :-1] & moved[:, 1:]
            before = np.where(same.all(axis=1), WIDE, (~same).argmax(axis=1))
            after = np.where(inside, moved, True)[:, ::-1]
            after = np.where(after.all(axis=1), WIDE, (~after).argmax(axis=1)) - (WIDE - n)
            ok = (common.sum(axis=1) >= self.size[b] - Q + 1 - Q) & (before + after >= n)
        for i in np.flatnonzero(~wide):
            ok[i] = one_edit(self.words[a[i]], self.words[b[i]])
        return ok

    def here(self, a: np.ndarray, b: np.ndarray, longer: bool) -> np.ndarray:
        """Whether a pair's rarest common gram is its list's."""
        gap = self.place[b][:, None, :] - self.place[a][:, :, None]
        match = (self.rank[a][:, :, None] == self.rank[b][:, None, :]) & ((gap == 0) | (longer & (gap == 1)))
        first = match.any(axis=2).argmax(axis=1)
        row = np.arange(len(a))
        return (first == self.own[a]) & (match[row, first].argmax(axis=1) == self.own[b])

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = {k: np.flatnonzero(self.role == k) for k in (ALONE, SHORTER, SAME, SPLIT)}
        listed = np.concatenate([rows[ALONE], rows[SPLIT]])
        for asking, among, shifts, ordered in ((rows[ALONE], rows[ALONE], (0,), True), (rows[SHORTER], listed, (0, 1), False), (rows[SAME], rows[SPLIT], (0,), False)):
            longer = len(shifts) > 1
            for a, b in self.pairs(asking, among, shifts, ordered):
                if not longer and not ordered:
                    less = np.array([self.words[i] < self.words[j] for i, j in zip(a, b, strict=True)], dtype=bool)
                    a, b = a[less], b[less]
                ok = self.verified(a, b, longer)
                a, b = a[ok], b[ok]
                ok = self.here(a, b, longer)
                yield a[ok], b[ok]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of near words of words (word, n), both ways, once each."""
    ranks = gram_ranks(words)
    lists = split_lists(saved(posted(words, ranks), "postings"))
    kinds = "word string, n long, near string, near_n long"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole lists, about MERGED_ROWS rows at once."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < MERGED_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in (*KEY, "part")])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if not len(ends):
                continue
            yield table.slice(0, int(ends[-1]))
            held = table.slice(int(ends[-1])).to_batches()
            n = sum(b.num_rows for b in held)
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            keys = np.stack([table.column(c).to_numpy() for c in (*KEY, "part")]).astype(np.int64)
            unit = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
            merge = Merge(unit, table.column("role").to_numpy(), table.column("own").to_numpy(), table.column("word").to_pylist(), ranks)
            word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
            for a, b in merge.near():
                one, other = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
                yield pa.RecordBatch.from_arrays([word.take(one), n.take(one), word.take(other), n.take(other)], ["word", "n", "near", "near_n"])

    return lists.repartition(*KEY, "part").sortWithinPartitions(*KEY, "part").mapInArrow(run, kinds)


def with_forms(words: DataFrame, near: DataFrame) -> DataFrame:
    """words with n_near, form and form_n."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    found = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
    top = -F.col("best.less")
    far = F.coalesce(top >= FORM_RATIO * F.col("n"), F.lit(False))
    return words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.near")).alias("form"), F.when(far, top).alias("form_n")
    )


def with_roots(forms: DataFrame, most: int) -> DataFrame:
    """forms with root, the end of a word's chain of forms. most: the largest n; each form has FORM_RATIO times its word's n, so chains are short."""
    depth = math.ceil(math.log(max(most, 1) / LEAST_COUNT + 1, FORM_RATIO))
    chain = forms.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, depth))))):
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = saved(chain.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return forms.join(chain, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variant_groups(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of docs (doc_id, text)."""
    words = saved(counted(edited_runs(docs)), "words")
    forms = saved(with_forms(words, near_pairs(words)), "forms")
    most: Column = F.max("n")
    return with_roots(forms, forms.agg(most).first()[0] or 0).select("word", "n", "n_near", "form", "form_n", "root")
