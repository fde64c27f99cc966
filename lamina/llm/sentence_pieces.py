"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton over the vocabulary's pieces reads a text once. At each position
it follows its output links to all pieces that end there, and each relaxes the
best path to that position from the one to its start.

What is best follows from the kind of model file. Unigram models: the largest
sum of scores. BPE models: scores are priorities of merges, and the largest sum
of all paths is not the library's result. There a piece relaxes a position only
from a path whose last piece it may follow: merging the text of both leaves these
two. Where merging gives one result, one piece of a position passes this test, and
the best path is the library's; several that pass compete by their sums. (Sums
take a step for each character outside the vocabulary, which becomes bytes.)

White space is part of a piece's start only, so a text is cut before white
space, and the ids of recurring cuts are kept in a bounded memory.

Decoding joins the pieces' bytes. The round trip is exact for texts without
U+2581, which stands for a space in this kind of model and comes back as one.

Defined cases: null and empty texts: no ids, decoded as empty. Repeated rows
each get their row. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_memory import ChunkMemory, flat, parts_of
from .common import whole_text

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Cuts of texts and pairs of pieces kept in a worker at most, and the longest cut that is; bytes of texts whose cuts are looked up at once.
CACHED_CUTS, CACHED_PAIRS, LONGEST_CUT, PART_BYTES = 700_000, 300_000, 48, 2_000_000
#: Set between cuts; texts that hold it are cut by CUT.
MARK = "\0"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


class Pieces:
    """A model file's pieces, and its encoder and decoder."""

    def __init__(self, model: bytes):
        import ahocorasick

        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model_type, self.dummy_prefix = UNIGRAM, True
        for field, value in _fields(model):
            if field == 1:
                entry = dict(_fields(value))
                self.pieces.append(entry.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(entry.get(2, b"\0\0\0\0"), dtype="<f4")[0]))
                self.kinds.append(entry.get(3, NORMAL))
            elif field == 2:
                self.model_type = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                self.dummy_prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only identity normalisation without removal of white space is supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        if self.model_type not in (UNIGRAM, BPE) or any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable):
            raise ValueError("unsupported kind of model")
        self.id_of = {self.pieces[i]: i for i in usable}
        self.lowest = min((self.scores[i] for i in usable), default=0.0) - 10.0
        self.made_of: dict[int, tuple[int, int]] = {}  # the two pieces of a piece's last merge
        if self.model_type == BPE:  # a piece that merging its own characters never yields is never used
            for i in usable:
                parts = self.merged(self.pieces[i], stop=2) if len(self.pieces[i]) > 1 else []
                if len(parts) == 2:
                    self.made_of[i] = (self.id_of.get(parts[0], -1), self.id_of.get(parts[1], -1))
            usable = [i for i in usable if len(self.pieces[i]) == 1 or i in self.made_of]
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i])))
        self.automaton.make_automaton()
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]
        self.cuts = ChunkMemory(CACHED_CUTS, LONGEST_CUT)
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """What merging leaves of a short text: the best-scored neighbours first, leftmost on ties; `stop` parts at least."""
        parts = list(text)
        while len(parts) > stop:
            found = [self.id_of.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = max((k for k, i in enumerate(found) if i is not None), key=lambda k: (self.scores[found[k]], -k), default=None)
            if best is None:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the text of both pieces leaves just these two.

        It does unless a merge across the border comes before one that made a
        piece: so the merges that made the pieces at the border are undone, the
        latest first, and each time the two at the border must not merge sooner.
        """
        pieces, scores = self.pieces, self.scores
        limit, wins_tie = float("-inf"), False
        while True:
            across = self.id_of.get(pieces[left] + pieces[right])
            if across is not None and (scores[across] > limit or (wins_tie and scores[across] == limit)):
                return False
            of_left, of_right = self.made_of.get(left), self.made_of.get(right)
            if of_left and not (of_right and scores[right] <= scores[left]):
                limit, wins_tie, left = scores[left], False, of_left[1]
            elif of_right:
                limit, wins_tie, right = scores[right], True, of_right[0]
            else:
                return True
            if left < 0 or right < 0:  # a character outside the vocabulary
                return True

    def best_path(self, text: str) -> list[int]:
        """Ids of a text in which spaces are U+2581."""
        n, none = len(text), -2
        last_of = [none] * (n + 1)  # last piece of the best path to each position; -1: a character outside the vocabulary, or the start
        start_of = [0] * (n + 1)
        total = [float("-inf")] * (n + 1)
        last_of[0], total[0] = -1, 0.0
        bpe, scores, pairs, n_pieces = self.model_type == BPE, self.scores, self.pairs, len(self.pieces)

        def settle(position: int) -> None:
            """Positions up to this one that no piece has reached end in a character outside the vocabulary."""
            at = position
            while last_of[at] == none:
                at -= 1
            for at in range(at, position):
                last_of[at + 1], start_of[at + 1], total[at + 1] = -1, at, total[at] + self.lowest

        for end, (piece, size) in self.automaton.iter(text):
            end += 1
            start = end - size
            last = last_of[start]
            if last == none:
                settle(start)
                last = -1
            score = total[start] + scores[piece]
            if score <= total[end]:
                continue
            if bpe and last >= 0:  # other characters never merge
                pair = last * n_pieces + piece
                if pair not in pairs:
                    pairs[pair] = self.may_follow(last, piece)
                if not pairs[pair]:
                    continue
            last_of[end], start_of[end], total[end] = piece, start, score
        settle(n)
        out: list[int] = []
        while n:
            start, piece = start_of[n], last_of[n]
            if piece >= 0:
                out.append(piece)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(text[start:n].encode("utf-8", "surrogatepass"))]
            else:
                out.append(self.unknown)
            n = start
        return out[::-1]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (uint32), one text after the other, and the number of each one's."""
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        return self.cuts.ids(self.cut(texts), [lambda cuts: flat([np.array(self.best_path(c), dtype=np.uint32) for c in cuts])])

    def cut(self, texts: pa.StringArray) -> pa.ListArray:
        """Texts before their spaces, which become U+2581."""
        if self.dummy_prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        spaced = pc.replace_substring(texts, " ", SPACE)
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            return pa.array([CUT.findall(x) for x in spaced.to_pylist()], pa.list_(pa.string()))
        return pc.split_pattern(pc.replace_substring_regex(spaced, f"({SPACE}+)", MARK + r"\1"), MARK)

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


CUT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One for each worker process and model, kept between its tasks."""
    if path not in _loaded:
        with open(path, "rb") as file:
            _loaded[path] = Pieces(file.read())
    return _loaded[path]


def _kept(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def _rows(of: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], list[np.ndarray]]]:
    """doc_id, text and ids of some rows at a time."""
    for part in parts_of(batches, PART_BYTES):
        texts = part.column("text").combine_chunks()
        ids, counts = of.encode(texts)
        pa.default_memory_pool().release_unused()
        yield part.column("doc_id").combine_chunks(), texts.to_pylist(), np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat(ids)[0].astype(np.int32)))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, _, ids in _rows(pieces(model), batches):
            yield pa.RecordBatch.from_arrays([doc_id, _lists(ids)], schema=schema)

    return _kept(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, model: str) -> DataFrame:
    """doc_id, text of each row of doc_id, ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pieces(model)
        for batch in batches:
            texts = [of.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _checked(docs: DataFrame, model: str, of_ids: list[tuple], kinds: str) -> DataFrame:
    """doc_id, columns of the ids (name, Arrow type, function of rows' ids), decoded_sha256, exact of each row."""
    schema = pa.schema([("doc_id", pa.int64()), *[(name, kind) for name, kind, _ in of_ids], ("decoded_sha256", pa.string()), ("exact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pieces(model)
        for doc_id, texts, ids in _rows(of, batches):
            back = [of.decode(x.tobytes()) for x in ids]
            digests = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())
            exact = pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([doc_id, *[make(ids) for _, _, make in of_ids], digests, exact], schema=schema)

    return _kept(docs).mapInArrow(run, f"doc_id long, {kinds}, decoded_sha256 string, exact boolean")


def _counted(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([len(x) for x in ids], pa.int64())


def encoded_and_checked(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, n_ids, decoded_sha256, exact of each row; the digest is of the text decoded from the ids."""
    return _checked(docs, model, [("ids", pa.list_(pa.int32()), _lists), ("n_ids", pa.int64(), _counted)], "ids array<int>, n_ids long")


def round_trip_report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit integers), decoded_sha256, exact: each row encoded, and decoded from its ids."""
    crc = lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
    return _checked(docs, model, [("n_ids", pa.int64(), _counted), ("ids_crc32", pa.int64(), crc)], "n_ids long, ids_crc32 long")
