"""A minimal perfect hash over 32-byte digests, as flat arrays.

Keys are placed level by level: a level is a bit array of twice as many bits as
keys remain, a key that lands alone sets its bit, the others go on.  A key's
slot is the number of set bits before its own, so ``n`` keys fill slots
``0..n-1`` exactly at about 3.5 bits a key.  A digest that was never inserted may still hit a
bit, which is why every slot holds the full digest to compare with.
"""

from __future__ import annotations

import numpy as np

from loomery.llm.shingles import mix

GAMMA = 2
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def as_words(digests: list[bytes] | np.ndarray) -> np.ndarray:
    """``(n, 4)`` 64-bit words of n 32-byte digests."""
    raw = digests if isinstance(digests, bytes) else b"".join(digests)
    return np.frombuffer(raw, np.uint64).reshape(-1, 4)


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        folded = (words * _MULTIPLIERS).sum(axis=1, dtype=np.uint64) + np.uint64(level) * np.uint64(0xA0761D6478BD642F)
    return (mix(mix(folded) ^ words[:, level % 4]) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Level sizes and the bits of all levels, end to end."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        """Over distinct digests; raises ValueError if two are equal."""
        sizes, levels, left = [], [], np.arange(len(words))
        while len(left):
            if len(levels) == 200:
                raise ValueError("digests are not distinct")
            size = max(GAMMA * len(left), 2)
            at = _place(words[left], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where it certainly was not inserted."""
        out, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _place(words[left], level, int(size)) + base
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
            base += int(size)
        return out


class Shard:
    """A perfect hash whose slots hold full digests and what belongs to them."""

    def __init__(self, words: np.ndarray, columns: list[np.ndarray], table: PerfectHash | None = None):
        self.table = table or PerfectHash.build(words)
        if table is None:
            slot = self.table.slots(words)
            order = np.argsort(slot)
            words, columns = words[order], [c[order] for c in columns]
        self.words, self.columns = words, columns

    def dump(self) -> dict[str, bytes]:
        return {
            "sizes": self.table.sizes.tobytes(),
            "bits": np.packbits(self.table.bits).tobytes(),
            "digests": self.words.tobytes(),
            "values": b"".join(c.astype(np.int64).tobytes() for c in self.columns),
        }

    @classmethod
    def load(cls, sizes: bytes, bits: bytes, digests: bytes, values: bytes) -> Shard:
        sizes_ = np.frombuffer(sizes, np.int64)
        table = PerfectHash(sizes_, np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes_.sum())).astype(bool))
        words = as_words(digests)
        flat = np.frombuffer(values, np.int64)
        return cls(words, list(flat.reshape(-1, len(words))) if len(words) else [], table)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each digest: whether all its 32 bytes are in the shard, and the slot."""
        slot = self.table.slots(words)
        maybe = np.flatnonzero(slot >= 0)
        member = np.zeros(len(words), bool)
        member[maybe] = (self.words[slot[maybe]] == words[maybe]).all(axis=1)
        return member, slot
