"""Removal of repeated passages with difference-cover anchors.

Words are runs of anything but space and 0x09-0x0D. A window is ``window`` words in a row within one document. A word goes
if a window that covers it also starts earlier: in a document with a smaller id, or earlier in the same document. Windows
are judged on the input.

A difference cover of a period p is a set of residues whose differences give every residue. Of two equal windows of w
words, wherever they start, some shift below p puts both on cover positions, so equal windows share an anchor: an aligned
run of w - p + 1 words at positions whose residue is in the cover. For w = 20 that is 4 positions in 13, and 8 words.

1. Documents are cut into blocks of coded words (``blocks.py``) and stored. Of documents with the same words only the
   first goes on; its copies lose all their words.
2. Blocks ask shards which of their anchors are seen elsewhere, 8 bytes an anchor, a bit back.
3. Repeated anchors extend: only windows that hold one are hashed (128 bits) and asked for; the reply says whether an
   equal window starts earlier.
4. Covered words are marked in each document and taken out.

No pairs are made, so a passage in a third of all documents costs one entry a block and question.

Defined results: null and empty texts have no words and keep the empty text. Rows are ordered by id and then start; rows that
share an id and a start are equals and none yields to the other, so repeated rows with one id stay alike. Rows without an id come
after all others. Documents shorter than a window stay. A document is one piece of work, so memory follows the longest one.
Windows are compared by 128-bit hashes of their words; the chance of a wrong match among 10^13 windows is below 1e-12.
Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import blocks as b
from riskloom.llm.shared import require, small_batches, stored

#: Perfect difference sets, each period with its residues.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
LEAST_ANCHOR = 8
NO_ID = 2**63 - 1

_BLOCK = "block long, ids array<long>, counts array<int>, codes binary, words binary"
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least ``LEAST_ANCHOR`` words, and its cover."""
    period = max((p for p in COVERS if window - p + 1 >= LEAST_ANCHOR), default=1)
    return period, COVERS[period]


def _rolled(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """The hash of each run of ``size`` values, at its start; shorter by size - 1."""
    n = max(len(hashes) - size + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out *= base
        out += hashes[k : k + n]
    return out


class Block:
    """A block's documents as one run of words."""

    def __init__(self, row: dict, window: int) -> None:
        self.window = window
        self.ids = np.array([NO_ID if i is None else i for i in row["ids"]], dtype=np.int64)
        self.counts = np.array(row["counts"], dtype=np.int64)
        [self.codes] = b.unpack(row["codes"], "<i4")
        [raw] = b.unpack(row["words"], None)
        self.words = raw.split(b" ") if raw else []
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), "<u8").reshape(-1, 2)
        self.lanes = [digests[:, i][self.codes] if len(self.words) else np.zeros(0, np.uint64) for i in (0, 1)]
        starts = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.pos = np.arange(len(self.codes)) - starts[self.doc] if len(self.codes) else np.zeros(0, np.int64)
        self.left = self.counts[self.doc] - self.pos if len(self.codes) else np.zeros(0, np.int64)
        self.starts = starts

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each document that has a window: its number, and a 128-bit hash of its words."""
        docs = np.flatnonzero(self.counts >= self.window)
        raw = [xxhash.xxh3_128_digest(self._joined(self.codes[s : s + n])) for s, n in zip(self.starts[docs], self.counts[docs], strict=True)]
        return docs, np.frombuffer(b"".join(raw), "<u8").reshape(-1, 2)

    def _joined(self, codes: np.ndarray) -> bytes:
        return b" ".join(map(self.words.__getitem__, codes.tolist()))

    def anchors(self, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word indexes of the anchors of first documents, and their hashes."""
        period, cover = cover_of(self.window)
        size = self.window - period + 1
        at_cover = np.isin(self.pos % period, cover) & (self.left >= size) & (self.counts >= self.window)[self.doc] & ~copies[self.doc]
        at = np.flatnonzero(at_cover)
        return at, _rolled(self.lanes[0], size, _BASES[0])[at]

    def candidates(self, anchors: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the repeated ``anchors``."""
        period, _ = cover_of(self.window)
        seen = np.zeros(len(self.codes) + period + 1, dtype=np.int64)
        seen[anchors + 1] = 1
        total = np.cumsum(seen)
        n = len(self.codes)
        holds = total[period : n + period] > total[:n]  # any in start .. start + period - 1
        return np.flatnonzero(holds & (self.left >= self.window) & ~copies[self.doc])

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_rolled(lane, self.window, base)[starts] for lane, base in zip(self.lanes, _BASES, strict=True))

    def kept(self, starts: np.ndarray, copies: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
        """Id, words, words removed and the text left, of each document."""
        edge = np.zeros(len(self.codes) + 1, dtype=np.int64)
        edge[starts] += 1
        np.subtract.at(edge, starts + self.window, 1)
        gone = np.cumsum(edge[:-1]) > 0
        for number, (start, n) in enumerate(zip(self.starts.tolist(), self.counts.tolist(), strict=True)):
            stays = np.zeros(0, np.int32) if copies[number] else self.codes[start : start + n][~gone[start : start + n]]
            yield number, n, n - len(stays), self._joined(stays)


def _order(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order by hash, id and start; in that order, which rows begin a hash, and which come later than its first."""
    order = np.lexsort((starts, ids, h2, h1))
    a, c, i, s = h1[order], h2[order], ids[order], starts[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(first) - 1
    lead = np.flatnonzero(first)
    later = (i != i[lead][group]) | (s != s[lead][group]) if len(order) else first
    return order, first, later


class Earliest:
    """The question whether an equal hash comes earlier, for the entries of one block."""

    def __init__(self, h1, h2, ids, starts, shards: int) -> None:
        order, first, later = _order(h1, h2, ids, starts)
        self.later_here = np.zeros(len(order), dtype=bool)
        self.later_here[order] = later
        asked = np.sort(order[first])  # in the order of the text, which packs well
        self.asked, self.h1, self.h2, self.ids, self.starts = asked, h1[asked], h2[asked], ids[asked], starts[asked]
        rank = np.zeros(len(order), dtype=np.int64)
        rank[order] = order[np.flatnonzero(first)][np.cumsum(first) - 1] if len(order) else 0
        self.lead = np.searchsorted(asked, rank)  # of each entry: the asked entry with its hash
        self.shard_of = (self.h1 % np.uint64(shards)).astype(np.int64)

    def messages(self) -> Iterator[tuple[int, bytes]]:
        for shard, part in b.dealt(self.shard_of):
            yield shard, b.pack(self.h1[part], self.h2[part], self.ids[part], self.starts[part].astype("<i8"))

    def earlier(self, replies: list[dict] | None) -> np.ndarray:
        """Of each entry: whether an equal one comes earlier, here or elsewhere."""
        elsewhere = b.placed(self.shard_of, replies, b.bits, bool)
        return self.later_here | (elsewhere[self.lead] if len(self.lead) else self.later_here)


def _earliest_reply(shard: int, payloads: list[bytes]) -> list[bytes]:
    parts = [b.unpack(p, "<u8", "<u8", "<i8", "<i8") for p in payloads]
    order, _, later = _order(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    out = np.zeros(len(order), dtype=bool)
    out[order] = later
    return [np.packbits(x).tobytes() for x in b.split_like(out, [len(p[0]) for p in parts])]


def _repeated_reply(shard: int, payloads: list[bytes]) -> list[bytes]:
    """Which keys another message names too; a message names a key once."""
    parts = [b.unpack(p, "<u8")[0] for p in payloads]
    _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    return [np.packbits(x).tobytes() for x in b.split_like(counts[inverse] > 1, [len(p) for p in parts])]


def word_blocks(docs: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    """``docs`` as blocks of coded words; a block ends with the document that fills it."""
    require(docs, (key, text))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size, ids, counts, codes, known = 0, 0, [], [], [], {}
        partition = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            columns = [
                pa.array([b.numbered(partition, made)], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int32())),
                pa.array([b.pack(np.concatenate(codes))], pa.binary()),
                pa.array([b.pack(b" ".join(known))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "counts", "codes", "words"])

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (body or b"").split()
                for w in words:
                    if w not in known:
                        known[w] = len(known)
                ids.append(doc)
                counts.append(len(words))
                codes.append(np.fromiter(map(known.__getitem__, words), "<i4", len(words)))
                size += len(body or b"") + 64
                if size >= block_bytes:
                    yield block()
                    made, size, ids, counts, codes, known = made + 1, 0, [], [], [], {}
        if ids:
            yield block()

    return docs.select(docs[key].cast("long").alias("id"), docs[text].cast("binary").alias("text")).mapInArrow(cut, _BLOCK)


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    window: int = 20,
    block_bytes: int = b.BLOCK_BYTES,
    shard_keys: int = b.SHARD_KEYS,
) -> DataFrame:
    """One row for each row of ``docs``: its key, ``n_words``, ``n_removed``, ``kept`` (words left, joined by a space)."""
    if window < 2:
        raise ValueError("window must be at least 2 words")
    small_batches(docs.sparkSession)
    blocks = stored(word_blocks(docs, key, text, block_bytes), "word-blocks")
    total = blocks.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n")).first()["n"]
    shards = b.shard_count(total or 0, shard_keys)

    def whole(block: Block) -> tuple[np.ndarray, Earliest]:
        found, digests = block.digests()
        return found, Earliest(digests[:, 0], digests[:, 1], block.ids[found], np.zeros(len(found), np.int64), shards)

    def copies_of(block: Block, row: dict) -> np.ndarray:
        found, question = whole(block)
        copies = np.zeros(len(block.counts), dtype=bool)
        copies[found] = question.earlier(row["copies"])
        return copies

    def anchored(block: Block, copies: np.ndarray):
        """Anchor indexes, the distinct hash of each, the distinct hashes, how often each comes here, their shards."""
        at, hashes = block.anchors(copies)
        distinct, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        return at, inverse, distinct, counts, (b.mixed(distinct) % np.uint64(shards)).astype(np.int64)

    def asked_windows(block: Block, copies: np.ndarray, row: dict) -> tuple[np.ndarray, Earliest]:
        at, inverse, _, counts, shard_of = anchored(block, copies)
        repeated = (counts > 1) | b.placed(shard_of, row["anchors"], b.bits, bool)
        starts = block.candidates(at[repeated[inverse]], copies)
        h1, h2 = block.windows(starts)
        return starts, Earliest(h1, h2, block.ids[block.doc[starts]], block.pos[starts], shards)

    def ask_copies(row: dict):
        return whole(Block(row, window))[1].messages()

    def ask_anchors(row: dict):
        block = Block(row, window)
        _, _, distinct, _, shard_of = anchored(block, copies_of(block, row))
        return [(shard, b.pack(distinct[part])) for shard, part in b.dealt(shard_of)]

    def ask_windows(row: dict):
        block = Block(row, window)
        return asked_windows(block, copies_of(block, row), row)[1].messages()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(i)[at].as_py() for i, n in enumerate(batch.schema.names)}
                block = Block(row, window)
                copies = copies_of(block, row)
                starts, question = asked_windows(block, copies, row)
                done = list(block.kept(starts[question.earlier(row["windows"])], copies))
                for lo in range(0, len(done), 1024):  # of a block's texts
                    _, n, removed, kept = zip(*done[lo : lo + 1024], strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row["ids"][lo : lo + 1024], pa.int64()),
                            pa.array(n, pa.int64()),
                            pa.array(removed, pa.int64()),
                            pa.array(kept, pa.binary()).cast(pa.string()),
                        ],
                        names=["id", "n_words", "n_removed", "kept"],
                    )

    copies = b.answer(b.ask(blocks, ask_copies), _earliest_reply)
    judged = b.with_replies(blocks, stored(copies, "copies"), "copies")
    anchors = b.answer(b.ask(judged, ask_anchors), _repeated_reply)
    judged = b.with_replies(judged, stored(anchors, "anchors"), "anchors")
    windows = b.answer(b.ask(judged, ask_windows), _earliest_reply)
    judged = b.with_replies(judged, stored(windows, "windows"), "windows")
    done = judged.mapInArrow(finish, "id long, n_words long, n_removed long, kept string")
    return done.withColumnRenamed("id", key)
