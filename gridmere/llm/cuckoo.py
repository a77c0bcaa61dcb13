"""A cuckoo filter over 64-bit hashes: a set that can forget, held in one small array."""

from __future__ import annotations

import numpy as np

_SLOTS = 4
_KICKS = 200


class CuckooFilter:
    """
    16-bit marks in buckets of four; each hash has two buckets, and either tells the other.

    `has` never misses a hash that was added; it wrongly finds about 1 in 8,000 others. Adding
    and removing work on whole arrays. Marks that find no place within 200 moves are kept in
    a list beside the table, so the filter stays right however full it is.
    """

    def __init__(self, cells: np.ndarray, stash: np.ndarray):
        self.cells, self.stash = cells, stash

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        """Empty, with room for n hashes at a load of at most 3/4."""
        buckets = 1 << max(2, (n * 4 // (3 * _SLOTS)).bit_length())
        return cls(np.zeros((buckets, _SLOTS), "u2"), np.zeros((0, 2), "i8"))

    @classmethod
    def from_bytes(cls, cells: bytes, stash: bytes) -> CuckooFilter:
        table = np.frombuffer(cells, "<u2").reshape(-1, _SLOTS).copy()
        return cls(table, np.frombuffer(stash, "<i8").reshape(-1, 2).copy())

    def to_bytes(self) -> tuple[bytes, bytes]:
        return self.cells.astype("<u2").tobytes(), self.stash.astype("<i8").tobytes()

    def _marks(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.astype("i8").view("u8")
        mark = np.maximum(h >> np.uint64(48), 1).astype("u2")
        return mark, (h & np.uint64(len(self.cells) - 1)).astype("i8")

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mark.astype("i8") * 0x5BD1E995 >> 7 & len(self.cells) - 1)

    def _place(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Puts marks into free slots, one for each bucket and slot; true where one was found."""
        placed = np.zeros(len(mark), bool)
        for slot in range(_SLOTS):
            todo = np.flatnonzero(~placed & (self.cells[bucket, slot] == 0))
            _, first = np.unique(bucket[todo], return_index=True)
            todo = todo[first]
            self.cells[bucket[todo], slot] = mark[todo]
            placed[todo] = True
        return placed

    def add(self, hashes: np.ndarray) -> None:
        mark, bucket = self._marks(hashes)
        for kick in range(_KICKS):
            for _ in range(2):
                left = ~self._place(bucket, mark)
                mark, bucket = mark[left], bucket[left]
                bucket = self._other(bucket, mark)
            if not len(mark):
                return
            slot = (mark + kick) % _SLOTS
            _, first = np.unique(bucket * _SLOTS + slot, return_index=True)
            moved, at = bucket[first], slot[first]
            out = self.cells[moved, at].copy()
            self.cells[moved, at] = mark[first]
            waiting = np.ones(len(mark), bool)
            waiting[first] = False
            mark = np.concatenate([mark[waiting], out])
            bucket = np.concatenate([bucket[waiting], self._other(moved, out)])
        self.stash = np.concatenate([self.stash, np.stack([bucket, mark.astype("i8")], axis=1)])

    def remove(self, hashes: np.ndarray) -> None:
        """Only for hashes that were added; each takes one mark away."""
        for mark, first in zip(*self._marks(hashes), strict=True):
            for bucket in (first, int(self._other(first, mark))):
                at = np.flatnonzero(self.cells[bucket] == mark)
                if len(at):
                    self.cells[bucket, at[0]] = 0
                    break
                beside = np.flatnonzero((self.stash[:, 0] == bucket) & (self.stash[:, 1] == mark))
                if len(beside):
                    self.stash = np.delete(self.stash, beside[0], axis=0)
                    break

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mark, bucket = self._marks(hashes)
        other = self._other(bucket, mark)
        found = ((self.cells[bucket] == mark[:, None]) | (self.cells[other] == mark[:, None])).any(axis=1)
        for place, own in self.stash:
            found |= ((bucket == place) | (other == place)) & (mark == own)
        return found
