"""CGK embedding of word sequences and hashed tables over it; numpy only, no Spark.

The embedding walks over a sequence: at step j it emits the word under the pointer and then moves on by a random bit that
depends on j and the word. An item that may differ in up to d words is cut into d + 1 pieces: whatever the d edits are,
scattered or in runs, one piece is left as it was. Each piece is an anchor: it is embedded by a walk of two steps a word
that does not leave it, so the untouched piece has the same embedding in the item and in the text, and no leak is missed.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np

WORDS = re.compile(r"[^\W_]+")
#: Pieces are walked up to this word; only small error rates have longer ones.
MOST_WORDS = 16
SEED = 77017


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def edited(sequence: np.ndarray, edits: int, vocabulary: int, rng: np.random.Generator) -> np.ndarray:
    """The sequence after random replacements, deletions and insertions of single words."""
    out = sequence.tolist()
    for _ in range(edits):
        kind, at = int(rng.integers(3)), int(rng.integers(max(1, len(out))))
        word = int(rng.integers(0, vocabulary))
        if kind == 0:
            out[at] = word
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, word)
    return np.array(out, dtype=np.int32)


def pieces(words: int, count: int) -> list[tuple[int, int]]:
    """The begin and length of ``count`` pieces that make up so many words."""
    edges = [k * words // count for k in range(count + 1)]
    return [(lo, min(hi - lo, MOST_WORDS)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


class Walk:
    """The random bits for pieces of one length, and the steps after which the embedding so far is looked up."""

    def __init__(self, size: int, vocabulary: int) -> None:
        self.size, self.steps = size, 2 * size
        self.bits = np.random.default_rng((SEED, size)).integers(0, 2, (self.steps, vocabulary), dtype=np.uint8)
        self.cuts = sorted({1, size, self.steps})

    def go(self, words: np.ndarray, starts: np.ndarray, at: np.ndarray, code: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Pointers and hashes of the embedding after step ``end``, from those after step ``begin``."""
        last = starts + (self.size - 1)
        for j in range(begin, end):
            word = words[at]
            code = code * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)
            at = np.minimum(at + self.bits[j][word], last)
        return at, code


def known(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The positions of the codes that are among the sorted ones."""
    place = np.searchsorted(sorted_codes, codes)
    return np.flatnonzero(sorted_codes[np.minimum(place, len(sorted_codes) - 1)] == codes)


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges in order, overlapping ones as one, so that no word is verified twice for an item."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


class WindowIndex:
    """Finds the windows of texts that may hold an item, and verifies them by their exact edit distance in words."""

    def __init__(self, items: list[tuple[int, str]], max_rate: float, design_rate: float, target: float, min_words: int, most: int) -> None:
        """Nothing is missed at any setting, so ``design_rate``, ``target`` and ``most`` have no effect; callers pass them still."""
        if not 0 <= max_rate < 1:
            raise ValueError("max_rate must be at least 0 and below 1")
        texts = [(item, words_of(text or "")) for item, text in items]
        texts = [(item, w) for item, w in texts if w]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in texts for w in ws}))}  # 0 is any other word
        self.items = [(item, np.array([self.vocabulary[w] for w in ws], dtype=np.int32)) for item, ws in texts]
        self.limits = [int(max_rate * len(s) + 1e-9) if len(s) >= min_words else 0 for _, s in self.items]
        self.masks = []
        for _, s in self.items:
            mask = defaultdict(int)
            for k, w in enumerate(s.tolist()):
                mask[w] |= 1 << k
            self.masks.append(dict(mask))
        anchors = defaultdict(list)
        for k, (_, s) in enumerate(self.items):
            for offset, size in pieces(len(s), self.limits[k] + 1):
                anchors[size].append((k, offset))
        self.classes = []
        for size, mine in sorted(anchors.items()):
            walk = Walk(size, len(self.vocabulary) + 1)
            self.classes.append((walk, *self._tables(walk, mine)))
        self.pad = max(anchors, default=0) + 1

    def _tables(self, walk: Walk, mine: list[tuple[int, int]]) -> tuple[list[np.ndarray], dict[int, list[tuple[int, int]]]]:
        """The sorted hashes of the anchors after each cut, and the (item, offset) of the anchors by the last one."""
        words = np.concatenate([self.items[k][1][offset : offset + walk.size] for k, offset in mine])
        starts = np.arange(len(mine), dtype=np.int64) * walk.size
        at, code, begin, codes, full = starts, np.zeros(len(mine), dtype=np.uint64), 0, [], defaultdict(list)
        for cut in walk.cuts:
            at, code = walk.go(words, starts, at, code, begin, cut)
            codes.append(np.unique(code))
            begin = cut
        for anchor, key in zip(mine, code.tolist(), strict=True):
            full[key].append(anchor)
        return codes, dict(full)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts as one array of word numbers with padding between them, and where each begins."""
        get = self.vocabulary.get
        parts, starts, at = [], [], 0
        gap = np.zeros(self.pad, dtype=np.int32)
        for text in texts:
            found = words_of(text)
            starts.append(at)
            parts += [np.fromiter((get(w, 0) for w in found), np.int32, len(found)), gap]
            at += len(found) + self.pad
        return (np.concatenate(parts) if parts else gap), np.array([*starts, at], dtype=np.int64)

    def candidates(self, words: np.ndarray) -> set[tuple[int, int, int]]:
        """(place, item, offset in the item) of every anchor that is found."""
        found = set()
        everywhere = np.arange(len(words) - self.pad, dtype=np.int64)
        for walk, codes, full in self.classes:
            starts, at, code, begin = everywhere, everywhere, np.zeros(len(everywhere), dtype=np.uint64), 0
            for cut, allowed in zip(walk.cuts, codes, strict=True):
                at, code = walk.go(words, starts, at, code, begin, cut)
                keep = known(allowed, code)
                starts, at, code, begin = starts[keep], at[keep], code[keep], cut
            for key, start in zip(code.tolist(), starts.tolist(), strict=True):
                for k, offset in full[key]:
                    found.add((start, k, offset))
        return found

    def best_match(self, words: list[int], k: int) -> tuple[int, int]:
        """The least edit distance of item k to any part of the words, and the end of the first part that has it.

        Bit-parallel columns of the edit-distance table, one bit for each word of the item.
        """
        masks, size = self.masks[k], len(self.items[k][1])
        full, top = (1 << size) - 1, 1 << (size - 1)
        up, down, score = full, 0, size
        best, end = size, 0
        for at, word in enumerate(words):
            same = masks.get(word, 0)
            vertical = same | down
            diagonal = (((same & up) + up) ^ up) | same
            rises = down | (full & ~(diagonal | up))
            falls = up & diagonal
            if rises & top:
                score += 1
            elif falls & top:
                score -= 1
            rises, falls = (rises << 1) & full, (falls << 1) & full
            up = falls | (full & ~(vertical | rises))
            down = rises & vertical
            if score < best:
                best, end = score, at + 1
        return best, end

    def matches(self, words: np.ndarray, begins: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text number, item number) -> (distance, first word, last word + 1) of the best verified window."""
        ranges = defaultdict(list)
        for place, k, offset in self.candidates(words):
            doc = int(np.searchsorted(begins, place, side="right")) - 1
            size, limit = len(self.items[k][1]), self.limits[k]
            lo, hi = max(int(begins[doc]), place - offset - limit), min(int(begins[doc + 1]) - self.pad, place - offset + size + limit)
            if hi > lo:
                ranges[doc, k].append((lo, hi))
        out = {}
        for (doc, k), mine in sorted(ranges.items()):
            for lo, hi in joined(mine):
                distance, end = self.best_match(words[lo:hi].tolist(), k)
                if distance <= self.limits[k] and ((doc, k) not in out or distance < out[doc, k][0]):
                    first = max(lo, lo + end - len(self.items[k][1]))
                    out[doc, k] = (distance, first - int(begins[doc]), lo + end - int(begins[doc]))
                if (doc, k) in out and out[doc, k][0] == 0:
                    break
        return out
