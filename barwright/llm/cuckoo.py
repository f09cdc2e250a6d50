"""A cuckoo filter over 64-bit hashes: a set that may say yes wrongly, never no, and that can forget.

Each hash has a 16-bit fingerprint and two buckets of four slots; the second bucket follows from the first and the
fingerprint, so an entry can be moved without its hash. Every inserted hash holds a slot of its own, also where
fingerprint and buckets equal another's, so removing one leaves the other. About 1 in 8,000 absent hashes is taken
for a present one.
"""

from __future__ import annotations

import numpy as np

from barwright.llm.words import U, mix

SLOTS = 4
FILL = 0.75
KICKS = 500


def buckets_for(n: int) -> int:
    """The smallest power of two of buckets that `n` hashes fill to at most three quarters."""
    return 1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * FILL)))))


class CuckooFilter:
    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.int64(len(table) - 1)

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        return cls(np.zeros((buckets_for(n), SLOTS), np.uint16))

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(np.ascontiguousarray(hashes, np.int64).view(U))
        print_ = ((h >> U(48)) % U(65535) + U(1)).astype(np.uint16)
        first = (h & U(0xFFFFFFFF)).astype(np.int64) & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ ((mix(print_.astype(U)) & U(0x7FFFFFFF)).astype(np.int64) & self.mask)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        p, a, b = self._places(hashes)
        return (self.table[a] == p[:, None]).any(1) | (self.table[b] == p[:, None]).any(1)

    def insert(self, hashes: np.ndarray) -> np.ndarray:
        """Insert distinct hashes; returns those that found no room (the filter is as if they had not been offered)."""
        hashes = np.asarray(hashes, np.int64)
        p, a, b = self._places(hashes)
        left = np.arange(len(hashes))
        for home in (a, b):
            for slot in range(SLOTS):
                free = left[self.table[home[left], slot] == 0]
                _, one = np.unique(home[free], return_index=True)  # one newcomer for each bucket and round
                put = free[one]
                self.table[home[put], slot] = p[put]
                left = np.setdiff1d(left, put, assume_unique=True)
        return hashes[[i for i in left if not self._kick(int(a[i]), int(p[i]))]]

    def _kick(self, bucket: int, print_: int) -> bool:
        moved: list[tuple[int, int, int]] = []
        for k in range(KICKS):
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = print_
                return True
            slot = (k * 7 + print_) % SLOTS
            moved.append((bucket, slot, int(row[slot])))
            print_, row[slot] = int(row[slot]), print_
            bucket = int(self._other(np.array([bucket]), np.array([print_], np.uint16))[0])
        for bucket, slot, was in reversed(moved):
            self.table[bucket, slot] = was
        return False

    def delete(self, hashes: np.ndarray) -> np.ndarray:
        """Forget hashes that were inserted; returns those whose fingerprint this filter does not hold."""
        hashes = np.asarray(hashes, np.int64)
        p, a, b = self._places(hashes)
        missing = []
        for i in range(len(hashes)):
            for bucket in (a[i], b[i]):
                hit = np.flatnonzero(self.table[bucket] == p[i])
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break
            else:
                missing.append(i)
        return hashes[missing]


class Chain:
    """Filters of one size, filled one after the other: a later one takes what the earlier had no room for.

    With one size, a hash has the same fingerprint and buckets in each part. Which part gives an entry up on deletion is
    then of no account: the entries of one fingerprint and pair of buckets are alike, and their number stays right.
    """

    def __init__(self, parts: list[CuckooFilter] | None = None):
        self.parts = parts or []

    @classmethod
    def load(cls, blobs: list[bytes]) -> Chain:
        return cls([CuckooFilter.load(b) for b in blobs])

    def dump(self) -> list[bytes]:
        return [p.dump() for p in self.parts]

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        for p in self.parts:
            out |= p.contains(hashes)
        return out

    def insert(self, hashes: np.ndarray, *, expected: int = 0) -> None:
        """`expected`: hashes the first part is sized for, if there is none yet."""
        for p in self.parts:
            if len(hashes):
                hashes = p.insert(hashes)
        while len(hashes):
            size = len(self.parts[0].table) if self.parts else buckets_for(max(expected, len(hashes)))
            self.parts.append(CuckooFilter(np.zeros((size, SLOTS), np.uint16)))
            hashes = self.parts[-1].insert(hashes)

    def delete(self, hashes: np.ndarray) -> None:
        for p in self.parts:
            if len(hashes):
                hashes = p.delete(hashes)
        if len(hashes):
            raise ValueError("hashes to delete were never inserted")
