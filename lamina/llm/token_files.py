"""Token-ID files coded with a static range asymmetric numeral system (rANS).

Documents are dealt to buckets by ranges of doc_id, sorted, encoded by the
tokenizer and written as segments of about SEGMENT_IDS ids. A segment is one
row of a Parquet table in the shared folder (bucket, segment, the documents' ids
and id counts, data), so files are committed by Spark, and a lost executor's
segments are written again. `data` is

    b"LRS1", n ids, symbols, scale bits, blocks, words, bytes an id    7 values
    symbols' ids and frequencies                                       the table that the segment's blocks share
    for each block: CRC-32 of its ids, and for each checkpoint
      the position in the word stream and LANES states
    word stream, 32-bit words, of each block after the other

A block is BLOCK ids at most in LANES interleaved lanes, coded on its own. Checkpoints
lie every CHECK steps; all checkpoints of all blocks are decoded side by side.
Checksums are verified when ids are read.

A text's ids are joined from those of its chunks: white space and what follows,
up to the next white space. The tokenizer's pre-tokenizer never joins a
character to white space after it, so a chunk's ids don't depend on what lies
around it. Chunks recur, and each is encoded by the library once while it is in
the bounded cache. Cutting and counting chunks is done by Arrow for many texts at
once; new chunks are joined to longer texts, as they would stand in one, for fewer
calls of the library, and told apart by the bytes of their pieces.

Defined cases: null text: empty, one end id. Null doc_id: kept, before all
others. Repeated rows are documents of their own, in order of their texts; where
thousands share a doc_id, in order of their texts' hashes first, so that they
spread over buckets. Empty table: no segment, empty result. Other columns are
not read.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunk_memory import ChunkMemory, flat, parts_of
from .common import Buckets, saved, whole_text

BLOCK, LANES, CHECK = 1 << 16, 64, 256
SEGMENT_IDS = 1 << 22
#: Documents of a bucket, about (larger ones hold more segments).
BUCKET_ROWS = 2048
#: Chunks of texts whose ids are kept at most, and the longest that is; bytes of texts whose chunks are looked up at once; chunks of a call of the library.
CACHED_CHUNKS, LONGEST_CHUNK, PART_BYTES, CALL_CHUNKS, JOINED_CHUNKS = 1_500_000, 48, 6_000_000, 50_000, 500
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4s6I")

#: Unicode White_Space, which the pre-tokenizer's pattern calls \s.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: Set between chunks; texts that hold it are cut by CHUNK.
MARK = "\0"


def normalised(counts: np.ndarray, scale: int) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2**scale."""
    total, want = counts.sum(), 1 << scale
    freq = np.maximum(1, counts * want // total)
    over = int(freq.sum() - want)
    for i in np.argsort(-freq, kind="stable") if over > 0 else ():  # the largest give way
        cut = min(over, int(freq[i]) - 1)
        freq[i] -= cut
        over -= cut
        if not over:
            break
    if over < 0:
        freq[int(freq.argmax())] -= over
    return freq.astype(np.uint64)


def encode_segment(ids: np.ndarray) -> bytes:
    """Ids (uint32) as a segment's data."""
    if not len(ids):
        return HEAD.pack(b"LRS1", 0, 0, 0, 0, 0, 4)
    tally = np.bincount(ids)
    symbols = np.flatnonzero(tally)
    counts = tally[symbols]
    rank = np.zeros(len(tally), dtype=np.int32)
    rank[symbols] = np.arange(len(symbols))
    index = rank[ids]
    scale = min(24, max(10, int(len(symbols)).bit_length() + 4))
    freq = normalised(counts.astype(np.int64), scale)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    blocks = -(-len(ids) // BLOCK)
    steps = -(-len(ids) // (blocks * LANES))
    size = steps * LANES
    laid = np.full(blocks * size, int(counts.argmax()), dtype=np.int32)
    laid[: len(ids)] = index
    laid = laid.reshape(blocks, steps, LANES)
    shift, low32 = np.uint64(63 - scale), np.uint64(0xFFFFFFFF)
    state = np.full((blocks, LANES), LOW, dtype=np.uint64)
    spilt = np.zeros((blocks, steps, LANES), dtype=bool)
    words = np.zeros((blocks, steps, LANES), dtype=np.uint32)
    marks = np.zeros((blocks, -(-steps // CHECK), LANES), dtype=np.uint64)
    for t in range(steps - 1, -1, -1):
        s = laid[:, t]
        f = freq[s]
        over = state >= (f << shift)
        spilt[:, t], words[:, t] = over, state & low32
        state = np.where(over, state >> np.uint64(32), state)
        quotient = state // f
        state = (quotient << np.uint64(scale)) + (state - quotient * f) + cum[s]
        if t % CHECK == 0:
            marks[:, t // CHECK] = state
    per_step = spilt.sum(axis=2)
    before = np.cumsum(per_step, axis=1) - per_step
    base = np.concatenate([[0], np.cumsum(per_step.sum(axis=1))[:-1]])
    places = (before[:, ::CHECK] + base[:, None]).astype(np.uint32)
    stream = words[spilt]
    crcs = np.array([zlib.crc32(ids[b * size : (b + 1) * size].astype("<u4").tobytes()) for b in range(blocks)], dtype=np.uint32)
    head = HEAD.pack(b"LRS1", len(ids), len(symbols), scale, blocks, len(stream), size)
    return b"".join([head, symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), crcs.tobytes(), places.tobytes(), marks.tobytes(), stream.tobytes()])


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment; ValueError where a checksum does not fit."""
    magic, n, k, scale, blocks, n_words, size = HEAD.unpack_from(data)
    if magic != b"LRS1":
        raise ValueError("not a segment")
    if not n:
        return np.zeros(0, dtype=np.uint32)
    steps = size // LANES
    n_marks = -(-steps // CHECK)
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    symbols, freq, crcs = take("<u4", k), take("<u4", k).astype(np.uint64), take("<u4", blocks)
    place = take("<u4", blocks * n_marks).astype(np.int64)
    state = take("<u8", blocks * n_marks * LANES).reshape(-1, LANES).copy()
    stream = np.concatenate([take("<u4", n_words), np.zeros(LANES, dtype=np.uint32)]).astype(np.uint64)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    of_slot = np.repeat(np.arange(k, dtype=np.int32), freq.astype(np.int64))
    mask, bits = np.uint64((1 << scale) - 1), np.uint64(scale)
    out = np.zeros((blocks, n_marks, CHECK, LANES), dtype=np.int32)
    flat = out.reshape(blocks * n_marks, CHECK, LANES)
    last = steps - (n_marks - 1) * CHECK  # steps after the last checkpoint
    live = np.arange(blocks * n_marks)
    for t in range(min(CHECK, steps)):
        if t == last and n_marks > 1:
            live = live[(live + 1) % n_marks != 0]
        x = state[live]
        slot = x & mask
        s = of_slot[slot.astype(np.int64)]
        flat[live, t] = s
        x = freq[s] * (x >> bits) + slot - cum[s]
        need = x < LOW
        order = place[live, None] + np.cumsum(need, axis=1) - 1
        x[need] = (x[need] << np.uint64(32)) | stream[order[need]]
        place[live] += need.sum(axis=1)
        state[live] = x
    ids = symbols[out.reshape(blocks, n_marks * CHECK, LANES)[:, :steps].reshape(-1)[:n]]
    for b in range(blocks):
        if zlib.crc32(ids[b * size : (b + 1) * size].astype("<u4").tobytes()) != crcs[b]:
            raise ValueError(f"block {b} is damaged")
    return ids


def chunks_of(texts: pa.StringArray) -> pa.ListArray:
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        return pa.array([CHUNK.findall(x) for x in texts.to_pylist()], pa.list_(pa.string()))
    return pc.split_pattern(pc.replace_substring_regex(texts, f"([{SPACES}]+)", MARK + r"\1"), MARK)


class Encoder:
    """A tokenizer with a bounded memory of chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # a byte is one character of a byte-level piece
        self.n_bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.memory = ChunkMemory(CACHED_CHUNKS, LONGEST_CHUNK)

    def joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For chunks that start with white space and end without: they follow each other in one string as they do in a text."""
        found, sizes = [], []
        for lo in range(0, len(chunks), CALL_CHUNKS):
            part = chunks[lo : lo + CALL_CHUNKS]
            texts = ["".join(part[i : i + JOINED_CHUNKS]) for i in range(0, len(part), JOINED_CHUNKS)]
            ids = np.array([i for e in self.library.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], dtype=np.uint32)
            ends, at = np.cumsum([len(c.encode()) for c in part]), np.cumsum(self.n_bytes[ids])
            last = np.searchsorted(at, ends)
            if len(at) and at[-1] == ends[-1] and (at[last] == ends).all():
                size = np.diff(last + 1, prepend=0)
            else:  # bytes don't tell where chunks end
                ids, size = self.each(part)
            found.append(ids)
            sizes.append(size)
        return np.concatenate(found), np.concatenate(sizes)

    def each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat([np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)])

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (uint32), one text after the other, and the number of each one's."""
        alone = lambda c: not (c and c[0] in SPACES and c[-1] not in SPACES)
        return self.memory.ids(chunks_of(texts), [self.joined, self.each], alone)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary, kept between its tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


SEGMENTS = "bucket int, segment int, doc_ids array<long>, counts array<int>, data binary"
_SEGMENTS = pa.schema([("bucket", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("data", pa.binary())])


def write_segments(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Encodes and writes all documents in ascending order of doc_id; the table of segments."""
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    buckets = Buckets(docs.select(k.alias("k")), BUCKET_ROWS)
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), k.alias("k"), whole_text().alias("text"))
        .withColumn("bucket", buckets.of(F.col("k"), F.xxhash64("text")).cast("int"))
        .repartitionById(buckets.count, F.col("bucket"))
        .sortWithinPartitions("bucket", "k", "text")
        .select("bucket", "doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer)
        end = np.array([end_id], dtype=np.uint32)
        now, number, size, held = None, 0, 0, []

        def segment() -> pa.RecordBatch:
            ids = np.concatenate([x for _, found in held for x in (found, end)])
            row = ([now], [number], [[d for d, _ in held]], [[len(x) + 1 for _, x in held]], [encode_segment(ids)])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _SEGMENTS, strict=True)], schema=_SEGMENTS)

        for part in parts_of(batches, PART_BYTES):
            ids, counts = of.encode(part.column("text").combine_chunks())
            at = 0
            for bucket, doc_id, n in zip(part.column("bucket").to_pylist(), part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                if held and (bucket != now or size >= SEGMENT_IDS):
                    yield segment()
                    number, size, held = (number + 1 if bucket == now else 0), 0, []
                now = bucket
                held.append((doc_id, ids[at : at + n]))
                at += n
                size += n + 1
        if held:
            yield segment()

    return saved(dealt.mapInArrow(write, SEGMENTS), "tokens", compression="uncompressed")


def starts(segments: DataFrame) -> DataFrame:
    """(bucket, segment, first): ids in all segments before. Totals of buckets (MOST_BUCKETS rows, and those of hot keys) are summed first."""
    count = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    sizes = segments.select("bucket", "segment", count.alias("n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    buckets = sizes.groupBy("bucket").agg(F.sum("n").alias("total"))
    offsets = buckets.select("bucket", F.coalesce(F.sum("total").over(earlier(Window.orderBy("bucket"))), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("bucket").orderBy("segment"))), F.lit(0))
    return sizes.withColumn("inside", inside).join(offsets, "bucket").select("bucket", "segment", (F.col("offset") + F.col("inside")).alias("first"))


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    schema = pa.schema([("bucket", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bucket, segment, doc_ids, counts, data = (batch.column(c)[row].as_py() for c in _SEGMENTS.names)
                ids = decode_segment(data).astype("<u4", copy=False)
                at = [0, *itertools.accumulate(counts)]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in itertools.pairwise(at)]
                n = len(doc_ids)
                columns = ([bucket] * n, [segment] * n, doc_ids, at[:-1], counts, crc)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    found = segments.mapInArrow(read, "bucket int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts(segments), ["bucket", "segment"]).select("doc_id", (F.col("at") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
