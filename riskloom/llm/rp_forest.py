"""Random-projection trees with spill overlap; numpy only, no Spark.

A tree is a heap of splits. The direction of a split comes from the node's number, so only its threshold is stored. The
threshold lies in the widest gap of the middle half of the sample's projections, which keeps tight groups together; vectors
within ``margin`` of it go to both sides. A node is a leaf when it is small enough or when no direction makes it smaller.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5
TRIES = 4
NODE = np.dtype([("threshold", "<f8"), ("attempt", "<i2")])  # attempt -1: a leaf


def unit(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _direction(node: int, split: int, attempt: int, size: int) -> np.ndarray:
    rng = np.random.default_rng((node & 0xFFFFFFFFFFFFFFFF, split, attempt))
    d = rng.standard_normal(size)
    return d / np.linalg.norm(d)


def fit(node: int, sample: np.ndarray, scale: float, max_leaf: int, margin: float) -> np.ndarray:
    """The splits below a node; ``scale`` is how many rows a sampled vector stands for."""
    tree = np.zeros(2 ** (DEPTH + 1), dtype=NODE)
    tree["attempt"] = -1
    todo = [(1, sample)]
    while todo:
        k, x = todo.pop()
        if k >= 2**DEPTH or len(x) * scale <= max_leaf or len(x) < 8:
            continue
        for attempt in range(TRIES):
            p = x @ _direction(node, k, attempt, x.shape[1])
            middle = np.sort(p)[len(p) // 4 : -(len(p) // 4)]
            gaps = np.diff(middle)
            at = int(gaps.argmax())
            threshold = (middle[at] + middle[at + 1]) / 2
            left, right = x[p < threshold + margin], x[p >= threshold - margin]
            if max(len(left), len(right)) <= 0.85 * len(x):
                tree[k] = (threshold, attempt)
                todo += [(2 * k, left), (2 * k + 1, right)]
                break
    return tree


def route(node: int, x: np.ndarray, tree: np.ndarray, margin: float, known: dict) -> list[tuple[int, bool, np.ndarray]]:
    """(heap place, whether it can still be split, row numbers) of every leaf that the rows reach.

    ``known`` remembers the directions of the node between calls.
    """
    out, todo = [], [(1, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        if not len(rows):
            continue
        threshold, attempt = tree[k]
        if attempt < 0:
            out.append((k, k >= 2**DEPTH, rows))
            continue
        if k not in known:
            known[k] = _direction(node, k, int(attempt), x.shape[1])
        p = x[rows] @ known[k]
        todo += [(2 * k, rows[p < threshold + margin]), (2 * k + 1, rows[p >= threshold - margin])]
    return out


def child(node: int, place: int) -> int:
    """The number of a node's leaf, as a signed 64-bit value."""
    x = (node * 0x9E3779B97F4A7C15 + place * 0xD6E8FEB86659FD93 + 1) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 32
    return x - 2**64 if x >= 2**63 else x


def least_reached(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least row number it is connected with."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least
