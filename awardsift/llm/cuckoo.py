"""A cuckoo filter over 64-bit keys with whole-array insertion, lookup and deletion."""

from __future__ import annotations

import numpy as np

from .words import mix

SLOTS = 4
LOAD = 0.85


class Full(Exception):
    """Some keys found no place; the filter has to be built anew with more room."""


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; each key has two buckets, and either follows from the other.

    Lookups never miss an inserted key. A key may be inserted several times and has to be deleted as often.
    """

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * LOAD)))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.mask = np.int64(len(self.table) - 1)

    @classmethod
    def of(cls, keys: np.ndarray, room: float = 1.0) -> CuckooFilter:
        capacity = max(16, int(len(keys) * room))
        while True:
            made = cls(capacity)
            try:
                made.insert(keys)
                return made
            except Full:
                capacity *= 2

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.table.tobytes()

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spread = mix(np.asarray(keys).astype(np.int64).view(np.uint64))
        marks = (spread >> np.uint64(48)).astype(np.uint16)
        marks[marks == 0] = 1
        return marks, (spread & np.uint64(0xFFFFFFFF)).astype(np.int64) & self.mask

    def _other(self, marks: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ ((mix(marks.astype(np.uint64)) >> np.uint64(20)).astype(np.int64) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        marks, bucket = self._place(keys)
        found = (self.table[bucket] == marks[:, None]).any(axis=1)
        rest = np.flatnonzero(~found)
        found[rest] = (self.table[self._other(marks[rest], bucket[rest])] == marks[rest, None]).any(axis=1)
        return found

    def insert(self, keys: np.ndarray, rounds: int = 500) -> None:
        """Place all keys, round by round: free slots first, then one eviction a bucket; raises Full without room."""
        marks, bucket = self._place(keys)
        draw = np.random.Generator(np.random.PCG64(1))
        for _ in range(rounds):
            order = np.argsort(bucket, kind="stable")
            marks, bucket = marks[order], bucket[order]
            first = np.concatenate(([True], bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, bool)
            start = np.flatnonzero(first)
            rank = np.arange(len(bucket)) - np.repeat(start, np.diff(np.append(start, len(bucket))))
            taken = self.table[bucket] != 0
            fits = rank < (~taken).sum(axis=1)
            slot = np.take_along_axis(np.argsort(taken, axis=1, kind="stable"), np.minimum(rank, SLOTS - 1)[:, None], axis=1)[:, 0]
            self.table[bucket[fits], slot[fits]] = marks[fits]
            marks, bucket = marks[~fits], bucket[~fits]
            if not len(marks):
                return
            _, one = np.unique(bucket, return_index=True)
            where = draw.integers(0, SLOTS, len(one))
            victims = self.table[bucket[one], where]
            self.table[bucket[one], where] = marks[one]
            marks[one] = victims
            bucket = self._other(marks, bucket)
        raise Full

    def delete(self, keys: np.ndarray) -> None:
        """Take out one fingerprint for each key, which must have been inserted."""
        for mark, home in zip(*self._place(keys)):
            for bucket in (home, self._other(np.array([mark]), np.array([home]))[0]):
                at = np.flatnonzero(self.table[bucket] == mark)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
