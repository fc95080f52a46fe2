"""A cuckoo filter over 16-byte keys: small, probed in bulk, and deletable."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500


def as_words(keys) -> np.ndarray:
    """16-byte keys (a list of bytes) as rows of two unsigned 64-bit numbers."""
    return np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)


class CuckooFilter:
    """16-bit tags in buckets of four; a key's two buckets differ by its tag's hash.

    ``contains`` never misses a key that was added and not removed; it may answer
    yes for others (about 8 in 65,536). The table doubles when an insertion finds
    no place, which needs the keys again: ``build`` takes them all.
    """

    def __init__(self, buckets: int):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.slots = np.zeros((buckets, SLOTS), dtype=np.uint16)

    @classmethod
    def build(cls, words: np.ndarray) -> "CuckooFilter":
        buckets = 1
        while buckets * SLOTS * 0.9 < len(words):
            buckets *= 2
        while True:
            made = cls(buckets)
            if made.add(words):
                return made
            buckets *= 2

    def _places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tags = (words[:, 1] % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
        mask = np.uint64(len(self.slots) - 1)
        first = words[:, 0] & mask
        return tags, first.astype(np.int64), (first ^ (self._spread(tags) & mask)).astype(np.int64)

    @staticmethod
    def _spread(tags):
        return np.asarray(tags).astype(np.uint64) * np.uint64(0x5BD1E995)

    def add(self, words: np.ndarray) -> bool:
        """Add the keys; False if one found no place (the filter is then to be rebuilt)."""
        mask, slots = len(self.slots) - 1, self.slots
        for tag, one, two in zip(*(x.tolist() for x in self._places(words)), strict=True):
            for at in (one, two):
                free = np.flatnonzero(slots[at] == 0)
                if len(free):
                    slots[at, free[0]] = tag
                    break
            else:
                at = two
                for kick in range(KICKS):
                    slot = (tag + kick) % SLOTS
                    tag, slots[at, slot] = int(slots[at, slot]), tag
                    at ^= (tag * 0x5BD1E995) & mask
                    free = np.flatnonzero(slots[at] == 0)
                    if len(free):
                        slots[at, free[0]] = tag
                        break
                else:
                    return False
        return True

    def remove(self, words: np.ndarray) -> None:
        """Remove keys that were added; removing others would lose foreign keys."""
        for tag, one, two in zip(*(x.tolist() for x in self._places(words)), strict=True):
            for at in (one, two):
                held = np.flatnonzero(self.slots[at] == tag)
                if len(held):
                    self.slots[at, held[0]] = 0
                    break

    def contains(self, words: np.ndarray) -> np.ndarray:
        tags, one, two = self._places(words)
        tags = tags[:, None]
        return (self.slots[one] == tags).any(axis=1) | (self.slots[two] == tags).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        made = cls.__new__(cls)
        made.slots = np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS).copy()
        return made
