"""A minimal perfect hash over 128-bit keys with arrays for each key, as one block of bytes; numpy only, no Spark.

Keys go through levels of bit arrays. A key that has a bit of its level to itself is placed there; the others try the
next, smaller level. The slot of a key is the number of set bits before its own, so n keys fill slots 0..n-1 exactly.
Next to the bits lie a fingerprint (the second key half), a count and a keeper for each slot.
"""

from __future__ import annotations

import struct

import numpy as np

_SPREAD = 2  # bits for each key that is still to be placed


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of both halves for a level."""
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
        return x ^ (x >> np.uint64(32))


def build(a: np.ndarray, b: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> bytes:
    """The block for distinct keys (a, b), both uint64."""
    left = np.arange(len(a))
    levels, order = [], []
    while len(left):
        size = max(64, -(-_SPREAD * len(left) // 8) * 8)
        at = (_mixed(a[left], b[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        levels.append(np.packbits(alone, bitorder="little"))
        order.append(left[placed][np.argsort(at[placed])])
        left = left[~placed]
    slots = np.concatenate(order) if order else np.empty(0, dtype=np.int64)
    head = struct.pack("<II", len(slots), len(levels)) + b"".join(struct.pack("<I", len(x)) for x in levels)
    parts = (b[slots].astype("<u8"), keepers[slots].astype("<i8"), counts[slots].astype("<u4"))
    return head + b"".join(x.tobytes() for x in levels) + b"".join(x.tobytes() for x in parts)


class Index:
    """Reads a block; ``find`` gives for each key its slot, or -1 where the fingerprint differs."""

    def __init__(self, block: bytes) -> None:
        n, depth = struct.unpack_from("<II", block)
        sizes = struct.unpack_from(f"<{depth}I", block, 8)
        at = 8 + 4 * depth
        self.levels, before = [], 0
        for size in sizes:
            bits = np.unpackbits(np.frombuffer(block, np.uint8, size, at), bitorder="little")
            self.levels.append((bits.view(bool), before + np.cumsum(bits, dtype=np.int64) - 1))
            before += int(bits.sum())
            at += size
        self.fingerprints = np.frombuffer(block, "<u8", n, at)
        self.keepers = np.frombuffer(block, "<i8", n, at + 8 * n)
        self.counts = np.frombuffer(block, "<u4", n, at + 16 * n)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slots = np.full(len(a), -1, dtype=np.int64)
        left = np.arange(len(a))
        for level, (bits, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = (_mixed(a[left], b[left], level) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            slots[left[here]] = ranks[at[here]]
            left = left[~here]
        found = slots >= 0
        found[found] = self.fingerprints[slots[found]] == b[found]
        return np.where(found, slots, -1)
