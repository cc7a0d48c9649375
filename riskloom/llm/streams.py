"""Groups out of sorted Arrow batches, for mapInArrow over partitions sorted by a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, where the key is the first column and equal keys follow each other.

    Only the rows of one key and one batch are in memory, so the caller bounds the size of a key's group.
    """
    open_key, open_parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if open_parts and keys[lo] != open_key:
                yield pa.Table.from_batches(open_parts)
                open_parts = []
            open_key = keys[lo]
            open_parts.append(batch.slice(lo, hi - lo))
    if open_parts:
        yield pa.Table.from_batches(open_parts)
