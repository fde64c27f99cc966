"""SimHash near-dedup by tiled exact comparison.

A document's fingerprint has bit i set if more than half of the 64-bit hashes
of its word shingles have it. Fingerprints that differ in `radius` or fewer
bits are linked; a document's class is the set of documents that links reach.

All distinct fingerprints are compared, in tiles: numpy exclusive-or and bit
counts over pairs of tiles, without those whose population counts differ beyond
the radius. The counts are those of the four 16-bit words of a fingerprint: a
bit that differs changes one of them by one, so two fingerprints within the
radius have count vectors within the radius in the L1 norm. Fingerprints are
sorted by total count and word counts, so that tiles have narrow ranges.

The units of work are pairs of blocks of BLOCK packs of PACK_ROWS fingerprints:
their size stays and their number grows with the data.

Copies are one fingerprint. Within a pair of blocks only links that join two
parts of a class not yet joined are emitted (a spanning forest), so a group of
thousands of near copies makes no quadratic output, and no link is lost.

Defined cases of near_duplicates: null and empty texts and texts of white space
have fingerprint zero, which links like any other; a text of fewer words than a
shingle is one shingle. Repeated rows each get their row. Rows that share a
doc_id but not a text are documents of their own, each in the class of its own
fingerprint. Null doc_id: kept, links others, and is named by the smallest other
doc_id of its class (null if there is none). Empty table: empty result. Other
columns are not read.

The pipeline's stage (one_of_similar) goes further: fingerprints of 256 bits, for
which each distinct shingle votes once, only search for pairs there, and a pair
counts by the exact similarity of its sets of shingles (64-bit hashes stand for
shingles). Tiles whose sizes of sets rule the similarity out are skipped too. The
first comparison finds the texts that have any candidate, and what chains of
candidates connect; the second one has these texts' sets, compares within such
chains only, and holds each candidate against the exact similarity in its tile.
Sets of few shingles are searched by bitmaps, one bit a shingle, in place of
votes: two bitmaps differ in no more bits than their sets in shingles, so that
search loses nothing. Its defined cases: texts without words are alike. Of the
rows of a class one stays: the smallest doc_id, then the least digest of the
text, then the least other columns; null doc_ids come last, and each class has
its own row whatever ids its rows share. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BUCKETS, range_bounds, range_bucket, saved, whole_text

#: Fingerprints of a tile: 512 x 512 comparisons fit the CPU's cache.
TILE = 512
#: Fingerprints of a pack, about, or shingles of one with sets, and packs of a block: pairs of blocks are the units of work.
PACK_ROWS, PACK_GRAMS, BLOCK = 2048, 1 << 18, 4
#: Tasks that the units are dealt to at most.
MOST_TASKS = 8192


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Lower-cases A-Z, takes ASCII-space-separated words and all shingles, repeats included."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    grams = [b" ".join(found)] if len(found) < shingle else list(map(b" ".join, zip(*[found[i:] for i in range(shingle)])))
    digest, votes = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(grams), 1 << 16):  # bounded memory for texts of any length
        bits = np.frombuffer(b"".join([digest(x, seed) for x in grams[at : at + (1 << 16)]]), dtype=np.uint8)
        votes += np.unpackbits(bits.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(grams)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and the fingerprint as a signed long for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column("text")], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], schema=schema)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(of, "doc_id long, fp long")


#: The Jaccard similarity of near duplicates' shingle sets, as a fraction.
LEAST = (4, 5)
#: Sets below so many shingles are searched by bitmaps, with the larger ones that they can be similar to: a fingerprint of few votes says little.
SHORT = 20
MOST_SHORT = (SHORT - 1) * LEAST[1] // LEAST[0]
#: By the sum of two sets' sizes: in how many shingles they differ at most at a similarity of LEAST.
APART = [s - 2 * -(-LEAST[0] * s // sum(LEAST)) for s in range(2 * MOST_SHORT + 1)]
#: 64-bit words of a fingerprint or bitmap of a set, and the bits that candidates differ in at most. A Jaccard similarity of
#: 0.8 is a cosine of 0.889, at which 38.8 of 256 bits differ on average with a standard deviation of 5.7, so this radius
#: misses one pair in 10,000 at 0.8 and none above 0.85; it asks for 57 % of pairs at 0.6, 11 % at 0.5 and no unrelated ones (128 +- 8).
WORDS, RADIUS = 4, 60


def may_reach(common, union):
    """Whether so many common shingles of so many are a similarity of LEAST."""
    return LEAST[1] * common >= LEAST[0] * union


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of each number."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_hash_of = _Hashes()
#: Words whose hashes a worker keeps at most.
CACHED_WORDS = 250_000


def gram_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: those of fingerprint()."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(_hash_of) > CACHED_WORDS:
        _hash_of.clear()
    words = np.fromiter(map(_hash_of.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(shingle, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = mixed(out) + words[i : len(words) - size + 1 + i]
    return np.unique(mixed(out))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_KEYS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64))


def votes_of(grams: np.ndarray) -> np.ndarray:
    """The WORDS 64-bit words of the fingerprint that distinct shingles vote for; zero if there are none."""
    out = np.zeros(8 * WORDS, dtype=np.uint8)
    places = np.arange(8, dtype=np.int64) * 256
    for k in range(WORDS):
        found = mixed(grams ^ _KEYS[k]).view(np.uint8).reshape(-1, 8)
        votes = np.bincount((found + places).ravel(), minlength=2048).reshape(8, 256) @ _BITS
        out[8 * k : 8 * k + 8] = np.packbits(2 * votes > len(grams), axis=1)[:, 0]
    return out.view(np.int64)


def bitmap_of(grams: np.ndarray) -> np.ndarray:
    """A bit for each shingle, in WORDS 64-bit words."""
    out = np.zeros(WORDS, dtype=np.uint64)
    np.bitwise_or.at(out, ((grams >> np.uint64(6)) % np.uint64(WORDS)).astype(np.int64), np.uint64(1) << (grams & np.uint64(63)))
    return out.view(np.int64)


def word_counts(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit words of each fingerprint's first 64 bits."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, 4)).astype(np.int32)


def gap(low_a, high_a, low_b, high_b):
    """Least L1 distance between count vectors in two boxes."""
    return np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)).sum(axis=-1)


class Boxes:
    """Ranges of some groups of fingerprints: of word counts and, where given, of sizes of sets and of classes."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        """Rows of four counts, the size, and the class."""
        self.low, self.high = low, high

    @staticmethod
    def of(fps: np.ndarray, others: list[np.ndarray], starts: list[int]) -> Boxes:
        facts = np.column_stack([word_counts(fps[:, 0]), *others])
        return Boxes(np.minimum.reduceat(facts, starts), np.maximum.reduceat(facts, starts))

    def meet(self, row: int, other: Boxes, radius: int) -> np.ndarray:
        """Which groups of other may hold a candidate for one of the row's."""
        a, b = (self.low[row], self.high[row]), (other.low, other.high)
        ok = gap(a[0][:4], a[1][:4], b[0][:, :4], b[1][:, :4]) <= radius
        if len(a[0]) > 4:
            ok &= may_reach(np.minimum(a[1][4], b[1][:, 4]), np.maximum(a[0][4], b[0][:, 4]))
        if len(a[0]) > 5:
            ok &= (a[0][5] <= b[1][:, 5]) & (b[0][:, 5] <= a[1][5])
        return np.flatnonzero(ok)


class Sets:
    """Sets of 64-bit numbers, one after the other, by their sizes."""

    def __init__(self, grams: np.ndarray, sizes: np.ndarray):
        self.grams, self.sizes = grams, sizes
        self.ends = np.cumsum(sizes)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' numbers, and the place in rows of each."""
        parts = [self.grams[self.ends[r] - self.sizes[r] : self.ends[r]] for r in rows]
        return np.concatenate(parts), np.repeat(np.arange(len(rows)), self.sizes[rows])


#: Distinct shingles that a matrix of sets has at once.
COLUMNS = 4096


def similar(near: np.ndarray, a: Sets, b: Sets, row: int, column: int) -> np.ndarray:
    """Which pairs of a tile, whose first one is (row, column), have a Jaccard similarity of LEAST."""
    x, y = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    (left, at_left), (right, at_right) = a.of(x + row), b.of(y + column)
    shared = np.intersect1d(left, right)

    def told(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number among the shared, place), by number."""
        number = np.searchsorted(shared, grams)
        kept = shared[np.minimum(number, len(shared) - 1)] == grams if len(shared) else np.zeros(len(grams), dtype=bool)
        order = np.argsort(number[kept], kind="stable")
        return number[kept][order], at[kept][order]

    (p, at_p), (q, at_q) = told(left, at_left), told(right, at_right)
    common = np.zeros((len(x), len(y)), dtype=np.float32)
    for lo in range(0, len(shared), COLUMNS):
        one, other = np.zeros((len(x), COLUMNS), dtype=np.float32), np.zeros((len(y), COLUMNS), dtype=np.float32)
        for matrix, number, at in ((one, p, at_p), (other, q, at_q)):
            some = slice(*np.searchsorted(number, (lo, lo + COLUMNS)))
            matrix[at[some], number[some] - lo] = 1
        common += one @ other.T
    common = common.astype(np.int64)
    out = np.zeros_like(near)
    out[np.ix_(x, y)] = may_reach(common, a.sizes[x + row][:, None] + b.sizes[y + column][None, :] - common)
    return out & near


def close(a: np.ndarray, b: np.ndarray, radius: int, sizes: tuple | None, apart: np.ndarray | None) -> np.ndarray:
    """Which rows of a and b, fingerprints of 64-bit words, differ in `radius` bits at most (and, of these sizes, in `apart`) and have sizes that allow a similarity of LEAST."""
    words = a.shape[1]
    first = max(1, words - 1)
    bits = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for k in range(1, first):
        bits += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    near = bits <= radius if apart is None else bits <= apart[sizes[0][:, None] + sizes[1][None, :]]
    if not near.any():
        return near
    if first < words or sizes:  # the few that are left
        x, y = np.nonzero(near)
        rest = bits[x, y] + np.bitwise_count(a[x, first:] ^ b[y, first:]).sum(axis=1, dtype=np.int64)
        ok = rest <= radius
        if sizes:
            p, q = sizes[0][x], sizes[1][y]
            ok &= may_reach(np.minimum(p, q), np.maximum(p, q))
            if apart is not None:
                ok &= rest <= apart[p + q]
        near[x, y] = ok
    return near


def joined(near: np.ndarray, row: int, column: int, parent: list[int]) -> list[tuple[int, int]]:
    """Links of a tile, whose first pair is (row, column), that join parts of parent not yet joined; joins them."""

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    while True:  # links inside a part already joined drop out at once
        of_rows = np.array([root(row + x) for x in range(near.shape[0])])
        of_columns = np.array([root(column + y) for y in range(near.shape[1])])
        near &= of_rows[:, None] != of_columns[None, :]
        open_rows = np.flatnonzero(near.any(axis=1))
        if not len(open_rows):
            return found
        for x, y in zip(open_rows, near[open_rows].argmax(axis=1), strict=True):
            i, j = row + int(x), column + int(y)
            p, q = root(i), root(j)
            if p != q:
                parent[max(p, q)] = min(p, q)
                found.append((i, j))


class Block:
    """Sorted fingerprints, rows of 64-bit words, with sizes of their sets, the sets and their classes where given."""

    def __init__(self, fps: np.ndarray, sizes: np.ndarray | None = None, grams: np.ndarray | None = None, parts: np.ndarray | None = None):
        self.fps, self.sizes, self.parts = fps.reshape(len(fps), -1), sizes, parts
        self.sets = None if grams is None else Sets(grams, sizes)
        self.starts = list(range(0, len(fps), TILE))
        self.boxes = Boxes.of(self.fps, [x for x in (sizes, parts) if x is not None], self.starts)


def spanning_links(a: Block, b: Block | None, radius: int, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between two blocks (or within one, b None) that form a spanning forest of all of them; indices, b's after a's.

    With sizes of shingle sets, links whose sizes alone rule out a Jaccard similarity of LEAST are none; `apart` limits the
    bits by the sum of sizes. With the sets, only links of that similarity are any; with classes, only those within one.
    """
    same, b = b is None, b or a
    shift = 0 if same else len(a.fps)
    parent = list(range(len(a.fps) + (0 if same else len(b.fps))))
    forest: list[tuple[int, int]] = []
    for k, row in enumerate(a.starts):
        rows = slice(row, row + TILE)
        for other in a.boxes.meet(k, b.boxes, radius):
            if same and other < k:
                continue
            columns = slice(b.starts[other], b.starts[other] + TILE)
            near = close(a.fps[rows], b.fps[columns], radius, None if a.sizes is None else (a.sizes[rows], b.sizes[columns]), apart)
            if a.parts is not None:
                near &= a.parts[rows][:, None] == b.parts[columns][None, :]
            if same and other == k:
                near = np.triu(near, 1)
            if a.sets and near.any():
                near = similar(near, a.sets, b.sets, row, columns.start)
            if near.any():
                forest += joined(near, row, columns.start + shift, parent)
    return forest


def links(fps: DataFrame, radius: int = 3, apart: list[int] | None = None) -> DataFrame:
    """fps: distinct (fp, rep), fp a long or an array of longs. Returns links (a, b), a > b, between reps, that connect what all links within the radius connect.

    With a column n_grams, only links whose sets' sizes allow a Jaccard similarity of LEAST count, and by the sum of sizes only
    those of `apart` bits at most. With columns grams (the sorted set, binary) and part too, only links of that similarity
    within a part (a number of 31 bits) count; rows that repeat a rep are one.
    """
    sized, exact = "n_grams" in fps.columns, "grams" in fps.columns
    limits = np.array(apart) if apart else None
    first = F.col("fp") if dict(fps.dtypes)["fp"] == "bigint" else F.get("fp", F.lit(0))
    word = lambda k: F.bit_count(F.shiftrightunsigned(first, 16 * k).bitwiseAND(65535)).cast("long")
    if exact:  # 31 bits of part, 12 of size, 20 that part a chain's sets of one size
        size = F.floor(128 * F.log1p("n_grams")).cast("long")
        order = (F.col("part") * (1 << 12) + size) * (1 << 20) + F.shiftrightunsigned(F.xxhash64("rep"), 44)
        buckets, weight = (fps.agg(F.sum("n_grams")).first()[0] or 0) // PACK_GRAMS, "n_grams"
    else:
        order = F.col("n_grams") if sized else ((F.bit_count(first).cast("long") * 17 + word(0)) * 17 + word(1)) * 17 + word(2)
        order, buckets, weight = order * (1 << 20) + F.shiftrightunsigned(F.xxhash64("fp"), 44), fps.count() // PACK_ROWS, None
    extra = [c for c in ("n_grams", "part", "grams") if c in fps.columns]
    keyed = fps.withColumn("key", order)
    bounds = range_bounds(keyed.select("key", *([weight] if weight else [])), "key", min(MOST_BUCKETS, buckets), weight)
    placed = keyed.select("fp", "rep", "key", *extra, range_bucket(F.col("key"), bounds).cast("int").alias("pack"))
    if exact:
        placed = placed.repartition("pack").groupBy("pack", "rep").agg(*[F.first(c).alias(c) for c in ("key", "fp", *extra)])

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "rep"])
        fp = np.stack(pdf["fp"].to_numpy()).reshape(len(pdf), -1)
        numbers = {c: pdf[c].to_numpy(np.int64) for c in extra if c != "grams"}
        box = Boxes.of(fp, list(numbers.values()), [0])
        blobs = [numbers[c].tobytes() if c in numbers else b"".join(pdf[c]) for c in extra]
        row = [pdf["pack"].iloc[0], box.low[0].tolist(), box.high[0].tolist(), fp.tobytes(), fp.shape[1], pdf["rep"].to_numpy().tobytes(), *blobs]
        return pd.DataFrame([row], columns=["pack", "low", "high", "fp", "words", "rep", *extra])

    blobs = "".join(f", {c} binary" for c in extra)
    packs = placed.groupBy("pack").applyInPandas(packed, "pack int, low array<long>, high array<long>, fp binary, words int, rep binary" + blobs)
    packs = saved(packs, "packs")
    boxes = sorted(map(tuple, packs.select("pack", "low", "high").collect()))  # ranges of a pack each
    if not boxes:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    numbers = np.array([p for p, _, _ in boxes]) // BLOCK
    blocks, starts = np.unique(numbers, return_index=True)
    box = Boxes(np.minimum.reduceat(np.array([x for _, x, _ in boxes]), starts), np.maximum.reduceat(np.array([x for _, _, x in boxes]), starts))
    n_blocks = int(blocks[-1]) + 1

    @F.pandas_udf("array<long>")
    def pairs_of(pack: pd.Series) -> pd.Series:
        """Numbers of the pairs of blocks that a pack's block is one of."""
        out = []
        for mine in pack // BLOCK:
            others = blocks[box.meet(int(np.searchsorted(blocks, mine)), box, radius)].astype(np.int64)
            out.append(np.minimum(mine, others) * n_blocks + np.maximum(mine, others))
        return pd.Series(out)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pack")
        sides = [g for _, g in pdf.groupby(pdf["pack"] // BLOCK)]
        column = lambda g, c, kind: np.frombuffer(b"".join(g[c]), dtype=kind) if c in g else None
        found = [
            Block(column(g, "fp", np.uint64).reshape(-1, int(g["words"].iloc[0])), column(g, "n_grams", np.int64), column(g, "grams", np.uint64), column(g, "part", np.int64))
            for g in sides
        ]
        reps = np.concatenate([column(g, "rep", np.int64) for g in sides])
        forest = spanning_links(found[0], found[1] if len(found) > 1 else None, radius, limits)
        ends = reps[np.array(forest, dtype=np.int64).reshape(-1, 2)]
        return pd.DataFrame({"a": ends.max(axis=1), "b": ends.min(axis=1)})

    n_units = sum(len(box.meet(k, box, radius)) for k in range(len(blocks)))
    dealt = packs.select(F.explode(pairs_of("pack")).alias("pair"), "pack", "fp", "words", "rep", *extra)
    return dealt.repartition(max(1, min(MOST_TASKS, n_units)), "pair").groupBy("pair").applyInPandas(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of each node's component: (node, root), for nodes other than roots.

    Alternates large-star and small-star steps on edges (a > b) until they are
    stars. Minima are aggregated before the shuffle and joined back; each round
    is written to the shared folder.
    """
    edges = saved(edges.distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        edges = saved(small.where("a > b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the class) for each row of docs."""
    prints = saved(fingerprints(docs, shingle, seed), "fingerprints")
    return named(prints, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def named(prints: DataFrame, radius: int) -> DataFrame:
    """prints (doc_id, fp) with component_id."""
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("rep", F.monotonically_increasing_id())
    fps = saved(fps, "fps")
    roots = components(links(fps.drop("least"), radius))
    classes = fps.join(roots, fps["rep"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "rep").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(classes.drop("least").join(ids, "root"), "fp")


def set_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, digest (of the text), grams_key (of the set of shingles), n_grams, fp (the set's fingerprint), bitmap (of a small set) of each row."""
    names = ["doc_id", "digest", "grams_key", "n_grams", "fp", "bitmap"]
    longs = pa.list_(pa.int64())
    schema = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.binary(), pa.int64(), longs, longs], strict=True)))

    def of_text(text: str) -> tuple:
        grams = gram_hashes(text, shingle)
        return xxhash.xxh3_128_digest(grams.tobytes()), len(grams), votes_of(grams), bitmap_of(grams) if len(grams) <= MOST_SHORT else None

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # one text's set at a time
            columns = zip(*[of_text(x.as_py()) for x in batch.column("text")], strict=True) if batch.num_rows else [[]] * 4
            made = [pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *made], schema=schema)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.md5(whole_text()).alias("digest"))
    return kept.mapInArrow(of, "doc_id long, digest string, grams_key binary, n_grams long, fp array<long>, bitmap array<long>")


def candidates(nodes: DataFrame, radius: int) -> DataFrame:
    """links() of nodes (rep, n_grams, fp, bitmap, and what else links() takes): small sets by their bitmaps, others by their fingerprints, those in between by both."""
    more = [c for c in nodes.columns if c not in ("rep", "n_grams", "fp", "bitmap")]
    long = nodes.where(F.col("n_grams") >= SHORT).select("fp", "rep", "n_grams", *more)
    short = nodes.where("bitmap is not null").select(F.col("bitmap").alias("fp"), "rep", "n_grams", *more)
    return links(long, radius).unionByName(links(short, max(APART), APART)).distinct()


def with_grams(nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """nodes (doc_id, digest, ...) with grams, the sorted hashes of the shingles of their texts; a row for each row of docs that a node names."""
    others = [c for c in nodes.columns if c not in ("doc_id", "digest")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = pa.array([gram_hashes(x.as_py(), shingle).tobytes() for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), grams], names=[*others, "grams"])

    told = docs.select(F.col("doc_id").cast("long").alias("d"), F.md5(whole_text()).alias("m"), whole_text().alias("text"))
    both = told.join(nodes, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("digest"))).select(*others, "text")
    kinds = dict(nodes.dtypes)
    return both.mapInArrow(add, ", ".join(f"{c} {kinds[c]}" for c in others) + ", grams binary")


def similar_roots(nodes: DataFrame, docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """(node, root) of nodes (rep, doc_id, digest, n_grams, fp, bitmap) that chains of pairs with a similarity of LEAST connect, for nodes other than roots."""
    roots = components(candidates(nodes.drop("doc_id", "digest"), radius))
    chained = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    part = F.shiftrightunsigned(F.xxhash64("root"), 33)  # chains that share it are compared in vain, but none is lost
    told = saved(with_grams(nodes.join(chained.select(F.col("node").alias("rep"), part.alias("part")), "rep"), docs, shingle), "sets")
    return components(candidates(told, radius))


def one_of_similar(docs: DataFrame, shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """Rows of docs, one for each class of texts that pairs of a Jaccard similarity of LEAST between their sets of shingles chain."""
    prints = saved(set_prints(docs, shingle), "set-prints")
    nodes = prints.groupBy("grams_key").agg(F.min(F.struct("digest", "doc_id", "n_grams", "fp", "bitmap")).alias("n")).select("grams_key", "n.*")
    nodes = saved(nodes.withColumn("rep", F.monotonically_increasing_id()), "nodes")
    roots = similar_roots(nodes.drop("grams_key"), docs, shingle, radius)
    classes = nodes.select("grams_key", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("grams_key", F.coalesce("root", "rep").alias("root"))
    return first_rows(docs, prints.select("doc_id", "digest", "grams_key").join(classes, "grams_key"))


def first_rows(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of docs, one for each root of members (doc_id, digest of the text, root): that of the smallest doc_id, then of the least digest; null doc_ids come last."""
    each = members.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n"))
    kept = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest", "n")).alias("k"))
    kept = saved(kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.digest").alias("kept_digest"), F.col("k.n").alias("n")), "kept")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    row = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(whole_text()).alias("digest"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    single = row.join(kept.where("n = 1"), same, "left_semi").select("doc.*")
    if not kept.where("n > 1").limit(1).count():
        return single
    ordered = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(whole_text()).alias("digest"), order.alias("order"))
    repeated = ordered.join(kept.where("n > 1"), same).groupBy("doc_id", "digest").agg(F.min_by("doc", "order").alias("doc")).select("doc.*")
    return single.unionByName(repeated)
