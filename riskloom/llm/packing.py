"""Hierarchical packing of documents into sequences of several lengths.

Each document becomes token ids followed by an end id. Whole windows of the longest tier are cut off its front; what is
left goes to the shortest tier that holds it. The longest rest opens a sequence of its tier. Its gap is filled with the
longest rests that fit, from this tier down; when none fits, the shortest one is cut to close the gap. Sequences are
therefore exactly as long as their tier. Only when a partition ends can one be short: what is left there is cut into the
tiers that fit, and the last piece makes the only padded sequence of the partition.

Sequences of one tier form steps of ``step_tokens`` tokens each, so that all steps weigh the same. They are numbered over
the whole table: the sequences of each partition and tier are counted and the counts added up, so that only the
last step of a tier can be short.

There is no shuffle: a partition is packed as it is read, in order, with less than two long windows and one batch of rests
in memory. The pieces are written once, and the steps numbered as they are read back. Sequence numbers carry the
partition number, so a task that runs again gives the same ones, as long as its input has a fixed order, as files have.

Defined results: null and empty texts are the end id alone; rows with equal or null ids are packed each for itself.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import keyed_text, small_batches, stored
from riskloom.llm.tokens import Encoder

TIERS = (128, 256, 512, 1024)
_RESULT = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, rank long"
)
_PARTITION_BITS = 33
MOST_SENT = 400_000  # rows of three numbers, about 10 MB


class Packer:
    """Packs rests (length, number, doc, start, ids, doc_tokens) of one partition; ``out`` collects finished pieces."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, partition: int) -> None:
        self.tiers, self.longest, self.step_tokens = tiers, tiers[-1], step_tokens
        self.base = partition << _PARTITION_BITS
        self.sequences = self.number = self.tokens = 0
        self.of_tier = dict.fromkeys(tiers, 0)
        self.rests: list[tuple] = []
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple], tier: int) -> None:
        step = self.base + self.of_tier[tier] * tier // self.step_tokens  # within the partition
        self.of_tier[tier] += 1
        offset = 0
        for length, _, doc, start, ids, total in pieces:
            self.out.append((doc, start, length, ids, total, self.base + self.sequences, offset, tier, step))
            offset += length
        self.sequences += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.longest
        for start in range(0, whole, self.longest):
            self._emit([(self.longest, 0, doc, start, ids[4 * start : 4 * (start + self.longest)], total)], self.longest)
        if whole < total:
            self._keep(total - whole, doc, whole, ids[4 * whole :], total)

    def _keep(self, length: int, doc, start: int, ids: bytes, total: int) -> None:
        self.number += 1
        insort(self.rests, (length, self.number, doc, start, ids, total), key=lambda r: r[:2])
        self.tokens += length

    def _take(self, gap: int) -> tuple:
        """The longest rest that fits the gap, or the front of the shortest one."""
        at = bisect_right(self.rests, gap, key=lambda r: r[0])
        length, number, doc, start, ids, total = self.rests.pop(at - 1 if at else 0)
        self.tokens -= length
        if length > gap:
            self._keep(length - gap, doc, start + gap, ids[4 * gap :], total)
            length, ids = gap, ids[: 4 * gap]
        return length, number, doc, start, ids, total

    def _fill(self, tier: int, size: int) -> None:
        pieces, gap = [], size
        while gap and self.rests:
            pieces.append(self._take(gap))
            gap -= pieces[-1][0]
        self._emit(pieces, tier)

    def pack(self) -> None:
        """Packs while every gap can be filled."""
        while self.tokens >= 2 * self.longest:
            longest = self.rests[-1][0]
            tier = next(t for t in self.tiers if t >= longest)
            self._fill(tier, tier)

    def finish(self) -> None:
        self.pack()
        while self.tokens:
            fits = [t for t in self.tiers if t <= self.tokens]
            tier = fits[-1] if fits else self.longest
            self._fill(tier, tier)


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    *,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = 0,
    step_tokens: int = 65_536,
) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence, its ids as little-endian 32-bit numbers.

    ``tokenizer`` is the path of a tokenizer file; the driver reads it and sends its content. ``tiers`` are the sequence
    lengths, ascending; ``step`` numbers the steps of a tier.
    """
    small_batches(docs.sparkSession)
    content = Path(tokenizer).read_text(encoding="utf-8")
    end = end_id.to_bytes(4, "little")
    names = [part.split()[0] for part in _RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(content)
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId())
        ranks = dict.fromkeys(tiers, -1)

        def rows() -> pa.RecordBatch:
            placed = []
            for *piece, offset, tier, _ in packer.out:
                ranks[tier] += offset == 0  # a sequence begins
                placed.append((*piece, offset, tier, ranks[tier]))
            columns = list(zip(*placed, strict=True)) or [[]] * len(kinds)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, encoded in zip(ids, encoder.encode(batch.column(1).to_pylist()), strict=True):
                packer.add(doc, encoded + end)
            packer.pack()
            yield rows()
        packer.finish()
        yield rows()

    texts = keyed_text(docs, key, text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_steps(stored(texts.mapInArrow(run, _RESULT), "packed"), step_tokens)


def _with_steps(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """``step`` in the place of ``rank``: the rank of a sequence among all of its tier tells its step.

    The counts have a row for each partition and tier. They are counted before they are sent to all tasks, and joined by a
    shuffle if there are more than ``MOST_SENT``.
    """
    part = F.shiftright("sequence_id", _PARTITION_BITS)
    counts = pieces.filter("offset = 0").groupBy(part.alias("part"), F.col("tier").alias("of_tier")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("of_tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "of_tier", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    before = stored(before, "sequences-before")
    few = F.broadcast(before) if before.count() <= MOST_SENT else before
    met = pieces.join(few, (part == before["part"]) & (pieces["tier"] == before["of_tier"]))
    step = F.expr(f"((before + rank) * tier) div {int(step_tokens)}")
    return met.select(*[c for c in pieces.columns if c != "rank"], step.cast("long").alias("step"))
