"""Minimal perfect hash of 64-bit keys, with a stored fingerprint for each key.

Levels of bit arrays: a key sets the bit of its level if no other key left
wants that bit, else it goes down a level. The rank of a key's bit among all
set bits is its number, so n keys get the numbers 0 to n - 1.
"""

from __future__ import annotations

import io

import numpy as np

from prescient.llm.common import mix64

#: Bits of a level for each key that reaches it.
SPREAD = 2.0
_STEP = 0xD6E8FEB86659FD93


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(h + np.uint64((level + 1) * _STEP % 2**64)) % np.uint64(size)).astype(np.int64)


def fingerprints(h: np.ndarray) -> np.ndarray:
    return (mix64(h ^ np.uint64(_STEP)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Built from distinct uint64 keys; ``find`` gives numbers in constant time."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray):
        self.levels, self.prints = levels, prints
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits, dtype=np.int64) - 1)
            base += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], mix64(keys)
        while left.size:
            size = max(int(left.size * SPREAD), 8)
            at = _place(left, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        out = cls(levels, np.zeros(0, dtype=np.uint32))
        out.prints = np.zeros(keys.size, dtype=np.uint32)
        out.prints[out._numbers(mix64(keys))] = fingerprints(keys)
        return out

    def _numbers(self, h: np.ndarray) -> np.ndarray:
        """Number of each hashed key, -1 for one that no level holds."""
        out = np.full(h.size, -1, dtype=np.int64)
        todo = np.arange(h.size)
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _place(h[todo], level, bits.size)
            hit = bits[at]
            out[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
            if not todo.size:
                break
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; -1 where the fingerprint shows another key."""
        at = self._numbers(mix64(keys))
        known = at >= 0
        known[known] = self.prints[at[known]] == fingerprints(keys[known])
        return np.where(known, at, -1)

    def to_bytes(self, **arrays: np.ndarray) -> bytes:
        """The hash and further arrays by number, as one blob."""
        out = io.BytesIO()
        np.savez(out, sizes=np.array([b.size for b in self.levels], dtype=np.int64),
                 bits=np.packbits(np.concatenate([*self.levels, np.zeros(0, dtype=bool)])),
                 prints=self.prints, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> tuple[PerfectHash, dict[str, np.ndarray]]:
        z = np.load(io.BytesIO(blob))
        sizes = z["sizes"]
        bits = np.unpackbits(z["bits"])[:int(sizes.sum())].astype(bool)
        levels = np.split(bits, np.cumsum(sizes)[:-1]) if sizes.size else []
        return cls(levels, z["prints"]), {k: z[k] for k in z.files
                                          if k not in ("sizes", "bits", "prints")}
