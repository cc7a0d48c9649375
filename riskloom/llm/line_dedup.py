"""Line deduplication with a sharded minimal perfect hash.

A line's key is the line without spaces and controls (0x20, 0x09-0x0D) at its ends, with A-Z in lower case. Keys of at
least ``min_chars`` code points found in at least ``min_docs`` documents lose their lines everywhere but in the document
with the largest id.

1. Each document gives the 128-bit hashes of its distinct keys; Spark counts them (combined before the shuffle) and keeps
   those that are frequent enough, with the largest id.
2. Those hashes are dealt to shards of about ``shard_keys`` keys; each shard becomes one block: minimal perfect hash,
   fingerprints, counts, keepers.
3. Documents probe the blocks: every line is sent, as a hash, to its shard. A task gets a shard's block first and then
   the lines that ask for it, as a stream in sort order, so its memory is a block and a batch. Each shard is dealt out
   ``salts`` times. The at most ``hot_keys`` keys that hold more than that share of all (document, key) pairs are probed
   where the document is read and send nothing.
4. Dropped line numbers come back to their documents.

Defined results: null and empty texts are one empty line. Every row is a document of its own; rows that share the
largest id all keep the line. Rows without id lose repeated lines unless no row with an id holds them. The whole 128 bits
are compared, so two different lines are taken for one with a chance below 1e-18 at 10^10 lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import perfect_hash
from riskloom.llm.shared import require, small_batches, stored

BLANK = " \t\n\v\f\r"
NO_KEEPER = -(2**63)


def line_hashes(text: str, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Line number and key hash of each line that is long enough."""
    for number, line in enumerate(text.split("\n")):
        key = line.strip(BLANK)
        if len(key) >= min_chars:
            yield number, xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests) or bytes(16), dtype="<u8").reshape(-1, 2)[: len(digests)]
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    require(docs, (key, text))
    whole = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[key].cast("long").alias("id"), F.xxhash64(whole).alias("body"), whole.alias("text"))


def repeated_lines(docs: DataFrame, key: str, text: str, min_chars: int, min_docs: int) -> tuple[DataFrame, int]:
    """Stored ``a, b, n_docs, keeper`` of the frequent keys, and the number of their (document, key) pairs."""

    def distinct_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = dict.fromkeys(h for _, h in line_hashes(body, min_chars))
                digests.extend(found)
                ids.extend([doc] * len(found))
            a, b = _halves(digests)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view("<i8")), pa.array(b.view("<i8")), pa.array(ids, pa.int64())], names=["a", "b", "id"]
            )

    pairs = _keyed(docs, key, text).select("id", "text").mapInArrow(distinct_keys, "a long, b long, id long")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
    kept = stored(counted.filter(F.col("n_docs") >= min_docs), "repeated-lines")
    summed = kept.agg(F.sum("n_docs").alias("n")).first()["n"]
    return kept, int(summed or 0)


def _block(rows: pd.DataFrame) -> bytes:
    keepers = rows["keeper"].fillna(NO_KEEPER).astype("int64").to_numpy()
    a, b = (rows[c].to_numpy("int64").view("uint64") for c in ("a", "b"))
    return perfect_hash.build(a, b, rows["n_docs"].to_numpy("int64"), keepers)


def build_index(repeated: DataFrame, shards: int) -> DataFrame:
    """One row for each shard that has keys: ``shard, block``."""

    def block_of(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "block": [_block(rows)]})

    sharded = repeated.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInPandas(block_of, "shard int, block binary")


_PROBE = "shard int, unit int, kind int, block binary, a long, b long, id long, body long, line int"
_DROP = "id long, body long, line int"


def _verdicts(index: perfect_hash.Index, a: np.ndarray, b: np.ndarray, ids: np.ndarray, min_docs: int):
    """Of each probed line: whether the index knows it, and whether it goes."""
    slots = index.find(a, b)
    known = slots >= 0
    goes = np.zeros(len(a), dtype=bool)
    at = slots[known]
    keepers = index.keepers[at]
    goes[known] = (index.counts[at] >= min_docs) & (keepers != ids[known]) & (keepers != NO_KEEPER)
    return known, goes


def dropped_lines(docs: DataFrame, key: str, text: str, min_chars: int, min_docs: int, shard_keys: int, hot_keys: int, salts: int):
    """``id, body, lines`` of the documents that lose lines; ``body`` is a hash of the text, so that repeated ids differ."""
    repeated, pairs = repeated_lines(docs, key, text, min_chars, min_docs)
    shards = max(1, -(-repeated.count() // shard_keys))
    # at most hot_keys rows can hold more than 1/hot_keys of the pairs, so this list is bounded by construction
    hot_rows = repeated.filter(F.col("n_docs") * hot_keys > pairs).toPandas()
    hot_block = _block(hot_rows)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = perfect_hash.Index(hot_block)
        for batch in batches:
            rows, numbers, digests = [], [], []
            for row, body in enumerate(batch.column(2).to_pylist()):
                for number, digest in line_hashes(body, min_chars):
                    rows.append(row)
                    numbers.append(number)
                    digests.append(digest)
            a, b = _halves(digests)
            rows = np.array(rows, dtype=np.int64)
            ids = batch.column(0).fill_null(NO_KEEPER).to_numpy()[rows]
            bodies = batch.column(1).to_numpy()[rows]
            known, goes = _verdicts(hot, a, b, ids, min_docs)
            ask = ~known | goes  # a line that a hot key keeps needs no answer; one that goes is already decided
            signed = a.view("<i8")
            kind = np.where(goes, 2, 1)[ask]
            shard = np.mod(signed, shards)[ask]
            unit = np.mod(rows + bodies, salts)[ask]
            n = int(ask.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard.astype(np.int32)),
                    pa.array(unit.astype(np.int32)),
                    pa.array(kind.astype(np.int32)),
                    pa.nulls(n, pa.binary()),
                    pa.array(signed[ask]),
                    pa.array(b.view("<i8")[ask]),
                    pa.array(ids[ask]),
                    pa.array(bodies[ask]),
                    pa.array(np.array(numbers, dtype=np.int32)[ask]),
                ],
                names=["shard", "unit", "kind", "block", "a", "b", "id", "body", "line"],
            )

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, of = None, None
        for batch in batches:
            shard, kind = (batch.column(i).to_numpy() for i in (0, 2))
            a, b, ids, bodies, line = (batch.column(i).fill_null(0).to_numpy() for i in (4, 5, 6, 7, 8))
            goes = kind == 2
            starts = np.flatnonzero(np.r_[True, (np.diff(shard) != 0) | (np.diff(kind) != 0)]) if len(shard) else []
            for lo, hi in zip(starts, [*starts[1:], len(shard)], strict=True):
                if kind[lo] == 0:
                    index, of = perfect_hash.Index(batch.column(3)[int(lo)].as_py()), shard[lo]
                elif kind[lo] == 1 and of == shard[lo]:
                    part = slice(lo, hi)
                    _, goes[part] = _verdicts(index, a[part].view("<u8"), b[part].view("<u8"), ids[part], min_docs)
            if goes.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[goes]) for x in (ids, bodies, line)], names=["id", "body", "line"])

    asked = _keyed(docs, key, text).mapInArrow(probes, _PROBE)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("a", "long"), ("b", "long"), ("id", "long"), ("body", "long"), ("line", "int"))]
    blocks = build_index(repeated, shards).select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("unit"), F.lit(0).alias("kind"), "block", *nothing
    )
    dealt = asked.unionAll(blocks).repartition("shard", "unit").sortWithinPartitions("shard", "kind")
    dropped = dealt.mapInArrow(answers, _DROP)
    lost = dropped.groupBy("id", "body").agg(F.collect_set("line").alias("lines"))
    return lost.withColumn("id", F.when(F.col("id") != NO_KEEPER, F.col("id")))


def dedup_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    min_chars: int = 20,
    min_docs: int = 3,
    shard_keys: int = 32_768,
    hot_keys: int = 4_096,
    salts: int = 16,
) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (all its columns), ``n_lines``, ``n_dropped``, ``kept`` (the text left)."""
    small_batches(docs.sparkSession)
    lost = dropped_lines(docs, key, text, min_chars, min_docs, shard_keys, hot_keys, salts)
    lost = lost.select(F.col("id").alias("lost_id"), F.col("body").alias("lost_body"), F.col("lines").alias("lost_lines"))
    whole = F.coalesce(docs[text], F.lit(""))
    left = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"),
        docs[key].cast("long").alias("id"),
        F.xxhash64(whole).alias("body"),
    )
    joined = left.join(lost, left["id"].eqNullSafe(lost["lost_id"]) & (left["body"] == lost["lost_body"]), "left")
    body = F.coalesce(F.col("row")[text], F.lit(""))
    lines = F.split(body, "\n", -1)
    n_lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    numbers = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("lost_lines"))
    kept = F.when(F.col("lost_lines").isNull(), body).otherwise(
        F.array_join(F.transform(numbers, lambda i: F.element_at(lines, i + 1)), "\n")
    )
    return joined.select(
        "row",
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("lost_lines").isNull(), F.lit(0)).otherwise(F.size("lost_lines")).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )
