"""A bounded memory of recurring chunks of texts and their ids, as Arrow and numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Gives chunks' ids (uint32), one chunk after the other, and the number of each one's.
Learner = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def flat(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of ids, as a learner gives them."""
    return np.concatenate([np.zeros(0, dtype=np.uint32), *found]), np.array([len(x) for x in found], dtype=np.int64)


class ChunkMemory:
    """Chunks' ids by chunk, `most` chunks and ten times as many ids at most; the chunks met least go first, long ones are not kept."""

    def __init__(self, most: int, longest: int):
        self.most, self.longest = most, longest
        self.known = pa.array([], pa.string())
        self.start, self.size, self.uses = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.pool = np.zeros(0, dtype=np.uint32)

    def forget(self) -> None:
        """Keeps the chunks met most often, half of the most at most."""
        often = np.argsort(-self.uses, kind="stable")[: self.most // 2]
        order = np.sort(often[self.uses[often] > 1])
        self.known, self.pool = self.known.take(pa.array(order)), self.gather(order)
        self.size, self.uses = self.size[order], np.ones(len(order), dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def gather(self, entries: np.ndarray) -> np.ndarray:
        """The entries' ids, one after the other."""
        size = self.size[entries]
        before = np.cumsum(size) - size
        return self.pool[np.repeat(self.start[entries] - before, size) + np.arange(int(size.sum()))]

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size, self.uses = np.concatenate([self.size, sizes]), np.concatenate([self.uses, np.zeros(len(sizes), dtype=np.int64)])
        self.pool = np.concatenate([self.pool, ids])

    def ids(self, texts: pa.ListArray, learners: list[Learner], kind_of: Callable[[str], int] = lambda _: 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each a list of chunks, one text after the other, and the number of each one's; new chunks go to the learner of their kind."""
        encoded = texts.flatten().dictionary_encode()
        index, distinct = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
        if len(self.known) + len(distinct) > self.most or len(self.pool) > 10 * self.most:
            self.forget()
        entry = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(entry < 0)
        missing = distinct.take(pa.array(new)).to_pylist()
        long, n_kinds = np.array([len(c) > self.longest for c in missing], dtype=bool), len(learners)
        kind = np.array([kind_of(c) for c in missing], dtype=np.int64) + n_kinds * long  # long ones last, to be cut off
        entry[new[np.argsort(kind, kind="stable")]] = len(self.start) + np.arange(len(new))
        for k in range(2 * n_kinds):
            part = [missing[i] for i in np.flatnonzero(kind == k)]
            if k == n_kinds:
                n_known, n_ids = len(self.start), len(self.pool)
            if k < n_kinds:
                self.known = pa.concat_arrays([self.known, pa.array(part, pa.string())])
            if part:
                self.add(*learners[k % n_kinds](part))
        self.uses[entry] += np.bincount(index, minlength=len(distinct))
        found = entry[index]
        total = np.concatenate([[0], np.cumsum(self.size[found])])
        ends = np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
        ids, counts = self.gather(found), np.diff(total[ends], prepend=0)
        self.start, self.size, self.uses, self.pool = self.start[:n_known], self.size[:n_known], self.uses[:n_known], self.pool[:n_ids]
        return ids, counts


def parts_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together, or cut, to about `most` bytes."""
    held, size = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for lo in range(0, batch.num_rows, step):
            piece = batch.slice(lo, step)
            held.append(piece)
            size += piece.nbytes
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
