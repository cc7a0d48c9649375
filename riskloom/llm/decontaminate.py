"""Benchmark decontamination: CGK embedding, hashed tables over item pieces, exact edit verification.

Items and documents are read as sequences of lower-cased words. A document leaks an item when some part of it is within
``max_rate`` times the item's words in edit distance (replaced, missing or added words). An item with d edits allowed is
cut into d + 1 pieces, one of which any leak holds unchanged. The pieces are embedded by the random walk of
``riskloom.llm.cgk``, and so are the words from each place of each document; where the two meet, the surroundings are
verified by their exact edit distance. Every leak within the limit is found, wherever its edits are; the parameters
``design_rate``, ``target`` and ``most_repetitions`` of the former trial are taken and have no effect.

Items go to the tasks in blocks of at most ``items_per_block`` rows, which bounds what is collected and sent; documents are
read once for each block and nothing of them is shuffled.

Defined results: items and documents that are null or empty have no words and match nothing; items of fewer than
``min_words`` words must occur exactly, word for word; repeated items are reported each under its
own id, items without id are left out. Documents are used whole, and long ones need memory in proportion to their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.cgk import WORDS, WindowIndex
from riskloom.llm.shared import keyed_text, require, small_batches

_RESULT = "doc_id long, item_id long, distance int, item_words int, start int, end int"


def indexes(
    items: DataFrame,
    key: str = "item_id",
    text: str = "text",
    *,
    max_rate: float = 0.2,
    design_rate: float = 0.1,
    target: float = 0.95,
    min_words: int = 8,
    most_repetitions: int = 32,
    items_per_block: int = 2_000,
) -> list[WindowIndex]:
    """The window indexes of all items, one for each block."""
    require(items, (key, text))
    rows = items.select(items[key].cast("long").alias("item_id"), items[text].alias("text")).filter("item_id is not null")
    blocks = max(1, -(-rows.count() // items_per_block))
    out = []
    for block in range(blocks):
        mine = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        index = WindowIndex([(r["item_id"], r["text"]) for r in mine], max_rate, design_rate, target, min_words, most_repetitions)
        if index.items:
            out.append(index)
    return out


def leaks(docs: DataFrame, found: list[WindowIndex], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item it leaks: the least distance, and the characters ``start`` to ``end`` around it."""
    small_batches(docs.sparkSession)
    texts = keyed_text(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long"))

    def search(index: WindowIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = []
                for (doc, k), (distance, first, last) in index.matches(*index.encode(bodies)).items():
                    spans = [m.span() for m in WORDS.finditer(bodies[doc].lower())]
                    item, sequence = index.items[k]
                    rows.append((ids[doc], item, distance, len(sequence), spans[first][0], spans[last - 1][1]))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = [pa.int64()] * 2 + [pa.int32()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["doc_id", "item_id", "distance", "item_words", "start", "end"],
                )

        return run

    out = docs.sparkSession.createDataFrame([], _RESULT)
    for index in found:
        out = out.unionAll(texts.mapInArrow(search(index), _RESULT))
    return out


def leaks_any(found: list[WindowIndex], text: Column) -> Column:
    """Whether a text leaks some item; for filters, as it needs no join."""

    @F.pandas_udf("boolean")
    def any_leak(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            bodies = [t or "" for t in texts]
            hit = pd.Series(False, index=range(len(bodies)))
            for index in found:
                for doc, _ in index.matches(*index.encode(bodies)):
                    hit[doc] = True
            yield hit

    return any_leak(text)
