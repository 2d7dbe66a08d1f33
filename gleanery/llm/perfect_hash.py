"""A minimal perfect hash of a set of digests, in numpy.

Level by level, every remaining key claims one bit of an array twice as long as the keys; keys that claim a bit alone keep it,
the others go on to the next level. A key's slot is the number of kept bits before its own: n keys fill the slots 0..n-1.
A key outside the set may land on any slot or none, so the slot must hold the digest to compare with.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gleanery.llm.words import mix64

GAMMA = 2
MAX_LEVELS = 200


def as_words(digests: list[bytes]) -> np.ndarray:
    """32-byte digests as an n x 4 matrix of 64-bit words."""
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mix64(keys[:, 0] + seed) ^ mix64(keys[:, 1] ^ seed)) % np.uint64(size)


@dataclass
class PerfectHash:
    sizes: np.ndarray
    bits: np.ndarray
    ranks: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        """From distinct keys."""
        sizes, levels, left = [], [], keys
        while len(left):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("the keys of a perfect hash must be distinct")
            size = GAMMA * len(left) + 1
            places = _places(left, len(sizes), size)
            alone = np.bincount(places.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[places]]
        return cls.of_bits(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool))

    @classmethod
    def of_bits(cls, sizes: np.ndarray, bits: np.ndarray) -> "PerfectHash":
        return cls(sizes, bits, np.cumsum(bits) - bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level keeps it (then it is not in the set)."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _places(keys[left], level, int(size)).astype(np.int64) + base
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left, base = left[~hit], base + int(size)
        return out

    def to_bytes(self) -> tuple[bytes, bytes]:
        return self.sizes.tobytes(), np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, sizes: bytes, bits: bytes) -> "PerfectHash":
        lengths = np.frombuffer(sizes, np.int64)
        flags = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(lengths.sum())).astype(bool)
        return cls.of_bits(lengths, flags)
