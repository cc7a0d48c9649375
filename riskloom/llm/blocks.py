"""Blocks of rows that put questions to shards.

An operator cuts its rows into blocks, one stored row for each, and a block asks about keys it holds: "is this seen
elsewhere?", "how often in all?". Its keys are dealt to shards by hash, one message for each block and shard; a shard sees
all messages that name its keys and replies to each in the order asked, so that a reply is as short as a bit a key. Equal
keys of a block are asked once, so a key that a third of all rows hold costs one entry a block.

Memory: a task holds a block, or the messages of a shard. ``block_bytes`` and ``shard_keys`` of the operators bound both;
their product sets how many keys travel in a message. Everything is keyed by block number, which is written with the
block, so a lost executor repeats only its own tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
SHARD_KEYS = 1 << 20

_MESSAGE = "shard int, block long, payload binary"
_REPLY = "block long, shard int, payload binary"


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as compressed bytes."""
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(r) for r in raw], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(raw))


def unpack(data: bytes, *kinds) -> list:
    """The arrays of ``pack``; a kind is a dtype, or None for bytes."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, "<i8", len(kinds)).tolist()
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(raw[at : at + size] if kind is None else np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def numbered(partition: int, count: int) -> int:
    """The number of a task's block: unique, and the same if the task runs again."""
    return (partition << 32) | count


def dealt(shard_of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of each shard that is asked: the positions of its keys, in order."""
    order = np.argsort(shard_of, kind="stable")
    sorted_shards = shard_of[order]
    cuts = np.flatnonzero(np.diff(sorted_shards)) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard_of[part[0]]), part


def mixed(keys: np.ndarray) -> np.ndarray:
    """A hash of 64-bit keys, for dealing them out."""
    x = keys.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def shard_count(keys: int, shard_keys: int) -> int:
    return max(1, -(-int(keys) // shard_keys))


def ask(blocks: DataFrame, question: Callable[[dict], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """One message for each block and shard; ``question`` gets a block's columns and gives shards and payloads."""

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(i)[at].as_py() for i, n in enumerate(batch.schema.names)}
                found = list(question(row))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([s for s, _ in found], pa.int32()),
                            pa.array([row["block"]] * len(found), pa.int64()),
                            pa.array([p for _, p in found], pa.binary()),
                        ],
                        names=["shard", "block", "payload"],
                    )

    return blocks.mapInArrow(messages, _MESSAGE)


def answer(messages: DataFrame, reply: Callable[[int, list[bytes]], list[bytes]]) -> DataFrame:
    """``block, shard, payload``: for each message the reply of its shard, which sees all of its messages together."""

    def of_shard(table: pa.Table) -> pa.Table:
        payloads = reply(table.column("shard")[0].as_py(), table.column("payload").to_pylist())
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "payload": pa.array(payloads, pa.binary())})

    return messages.groupBy("shard").applyInArrow(of_shard, _REPLY)


def with_replies(blocks: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """Each block with its replies as a list of shard and payload; null where it asked nothing."""
    gathered = replies.groupBy(F.col("block").alias("_of")).agg(F.collect_list(F.struct("shard", "payload")).alias(name))
    return blocks.join(gathered, blocks["block"] == gathered["_of"], "left").drop("_of")


def placed(shard_of: np.ndarray, replies: list[dict] | None, decode: Callable[[bytes, int], np.ndarray], dtype) -> np.ndarray:
    """The replies of all shards in the order of the keys."""
    out = np.zeros(len(shard_of), dtype=dtype)
    by_shard = {r["shard"]: r["payload"] for r in replies or []}
    for shard, part in dealt(shard_of):
        out[part] = decode(by_shard[shard], len(part))
    return out


def bits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


def split_like(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1]) if sizes else []
