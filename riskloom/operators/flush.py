"""Flush batches: which rows a buffering writer writes together.

A batch of a key opens with its first row; it closes with the row that makes it ``most_rows`` long, or with the last row less
than ``within_ms`` after the first. The next batch opens with the row that follows. So where a batch opens depends on all
batches before it, which reads like a loop over the rows; here each row points to the row that would open the next batch
if one opened with it, and the pointers are doubled: after k rounds a row knows where 2^k batches lead.

1. Rows of a key are numbered in order of time and id. Spark sorts them over many partitions, so a key that holds
   most rows is no single task; a partition's rows are then counted, and the counts added up.
2. A key is cut into slices of ``slice_rows`` numbers. Each slice also gets the ``most_rows`` rows behind it, as no batch is
   longer. Within a slice pointers are doubled until each of its first ``most_rows`` rows, where a batch of the slice
   before may end, knows where it enters the next slice.
3. These few numbers a slice are chained over the slices by doubling too, as joins, which gives each slice the row where its
   first batch opens.
4. From there each slice marks its batches.

Rows without a key or a time are left out. Equal times are ordered by id; rows equal in both are interchangeable.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import enable_checkpoints

ROWS_PER_SLICE = 250_000


def numbered(rows: DataFrame, parts: int) -> DataFrame:
    """``key, time_ms, id, place``: the rows of each key numbered from 0 by time and id."""
    enable_checkpoints(rows.sparkSession)
    ranged = rows.repartitionByRange(parts, "key", "time_ms", "id").withColumn("part", F.spark_partition_id())
    ranged = ranged.checkpoint()  # later stages and retries must see the same partition numbers
    counts = ranged.groupBy("key", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("key", "part").orderBy("time_ms", "id"))
    placed = ranged.withColumn("rank", rank).join(before, ["key", "part"])
    return placed.select("key", "time_ms", "id", (F.col("before") + F.col("rank") - 1).alias("place"))


def pointers(times: np.ndarray, most_rows: int, within_ms: int) -> np.ndarray:
    """Of each row of a slice: the row that opens the next batch if a batch opens with it."""
    last = np.searchsorted(times, times + within_ms, side="left")
    return np.minimum(last, np.arange(len(times)) + most_rows)


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    place = table.column("place").to_numpy()
    order = np.argsort(place, kind="stable")
    return place[order], table.column("time_ms").to_numpy()[order]


def exits(times: np.ndarray, length: int, most_rows: int, within_ms: int) -> np.ndarray:
    """Of each of the first rows of a slice of ``length`` rows: the first batch opening at or behind its end."""
    to = np.append(pointers(times, most_rows, within_ms), len(times))
    inside = np.arange(len(to)) < length
    while True:
        further = np.where(to < length, to[to], to)
        if np.array_equal(further, to):
            break
        to = further
    return np.where(inside, to, np.arange(len(to)))[: min(most_rows, length)]


def openings(times: np.ndarray, length: int, entry: int, most_rows: int, within_ms: int) -> np.ndarray:
    """The rows of a slice that open a batch, if the first one opens at ``entry``."""
    to = pointers(times, most_rows, within_ms)
    found, at = [], entry
    while at < length:
        found.append(at)
        at = int(to[at])
    return np.array(found, dtype=np.int64)


def flush_batches(
    rows: DataFrame, key: str, time_ms: str, row_id: str, *, most_rows: int = 500, within_ms: int = 200, slice_rows: int = ROWS_PER_SLICE
) -> DataFrame:
    """``key, batch, rows, first_id, first_ms, last_ms``, batches of a key numbered from 1."""
    if most_rows < 1 or within_ms < 1:
        raise ValueError("a batch holds at least a row and a millisecond")
    slice_rows = max(slice_rows, most_rows)
    given = rows.select(rows[key].alias("key"), rows[time_ms].cast("bigint").alias("time_ms"), rows[row_id].alias("id"))
    given = given.where("key is not null and time_ms is not null")
    total = given.count()
    placed = numbered(given, max(2, -(-total // slice_rows)))
    own = F.expr(f"place div {slice_rows}")
    ahead = F.expr(f"place % {slice_rows}") < most_rows
    slices = F.when(ahead & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    cut = placed.select("key", F.explode(slices).alias("slice"), "place", "time_ms")

    def leave(group: tuple, table: pa.Table) -> pa.Table:
        place, times = _arrays(table)
        start = group[1].as_py() * slice_rows
        length = int((place < start + slice_rows).sum())
        to = exits(times, length, most_rows, within_ms)
        n = len(to)
        # a slice that its key ends with leads nowhere
        onward = to >= length if length == slice_rows and len(place) > length else np.zeros(n, bool)
        return pa.table({
            "key": pa.array([group[0].as_py()] * n, table.schema.field("key").type), "slice": pa.array([group[1].as_py()] * n, pa.int64()),
            "entry": pa.array(np.arange(n), pa.int64()), "exit": pa.array(np.where(onward, to - slice_rows, -1), pa.int64()),
        })

    kind = dict(given.dtypes)["key"]
    hops = cut.groupBy("key", "slice").applyInArrow(leave, f"key {kind}, slice bigint, entry bigint, exit bigint")
    enters = _entries(hops.checkpoint())

    def mark(group: tuple, table: pa.Table) -> pa.Table:
        entry = table.column("entry").combine_chunks().drop_null()
        rest = table.filter(pc.is_valid(table.column("time_ms")))
        place, times = _arrays(rest)
        start = group[1].as_py() * slice_rows
        length = int((place < start + slice_rows).sum())
        found = openings(times, length, entry[0].as_py(), most_rows, within_ms) if len(entry) else np.zeros(0, np.int64)
        ends = pointers(times, most_rows, within_ms)[found] if len(found) else found
        n = len(found)
        return pa.table({
            "key": pa.array([group[0].as_py()] * n, table.schema.field("key").type), "opens": pa.array(place[found], pa.int64()), "rows": pa.array(ends - found, pa.int64()),
            "first_ms": pa.array(times[found], pa.int64()), "last_ms": pa.array(times[ends - 1] if n else times[:0], pa.int64()),
        })

    with_entry = cut.withColumn("entry", F.lit(None).cast("bigint")).unionByName(
        enters.select("key", "slice", F.lit(None).cast("bigint").alias("place"), F.lit(None).cast("bigint").alias("time_ms"), "entry")
    )
    found = with_entry.groupBy("key", "slice").applyInArrow(mark, f"key {kind}, opens bigint, rows bigint, first_ms bigint, last_ms bigint")
    first = placed.select("key", F.col("place").alias("opens"), F.col("id").alias("first_id"))
    named = found.join(first, ["key", "opens"])
    return _counted(named, slice_rows).select("key", "batch", "rows", "first_id", "first_ms", "last_ms")


def _entries(hops: DataFrame) -> DataFrame:
    """``key, slice, entry``: where the first batch of each slice opens, from slice 0 on, by doubling the hops."""
    slices = hops.groupBy("key").agg((F.max("slice") + 1).alias("n"))
    most = slices.agg(F.max("n").alias("n")).first()["n"] or 0
    known = hops.where("slice = 0 and entry = 0").select("key", "slice", "entry")
    step, reach = hops, 1
    while reach < most:
        # known: the first ``reach`` slices; step: from a slice to the one ``reach`` behind it
        on = known.join(step.where("exit >= 0"), ["key", "slice", "entry"])
        known = known.unionAll(on.select("key", (F.col("slice") + reach).alias("slice"), F.col("exit").alias("entry"))).checkpoint()
        ahead = step.select(F.col("key").alias("k"), F.col("slice").alias("s"), F.col("entry").alias("e"), F.col("exit").alias("further"))
        met = (F.col("key") == F.col("k")) & (F.col("slice") + reach == F.col("s")) & (F.col("exit") == F.col("e"))
        step = step.join(ahead, met).select("key", "slice", "entry", F.col("further").alias("exit")).checkpoint()
        reach *= 2
    return known


def _counted(batches: DataFrame, slice_rows: int) -> DataFrame:
    """Numbers the batches of a key: within slices first, then the slices' counts are added up."""
    inside = batches.withColumn("slice", F.expr(f"opens div {slice_rows}"))
    rank = F.row_number().over(Window.partitionBy("key", "slice").orderBy("opens"))
    counts = inside.groupBy("key", "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("key", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return inside.withColumn("rank", rank).join(before, ["key", "slice"]).withColumn("batch", F.col("before") + F.col("rank"))
