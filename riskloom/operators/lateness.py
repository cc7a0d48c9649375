"""Late rows, for input whose watermark is known per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lateness(ts_ms: Column, watermark_ms: Column, allowed_ms: int = 0) -> Column:
    """``ON_TIME``, ``TOLERATED`` or ``LATE``.

    A row at or behind the watermark is late unless the allowed lateness still covers it; without a watermark nothing
    is late.
    """
    return (
        F.when(watermark_ms.isNull() | (ts_ms > watermark_ms), F.lit("ON_TIME"))
        .when(ts_ms > watermark_ms - allowed_ms, F.lit("TOLERATED"))
        .otherwise(F.lit("LATE"))
    )


_GROUP_BITS = 16
_LEVELS = 3


def _newest_before(newest: DataFrame, level: int = _LEVELS) -> DataFrame:
    """``key, before``: the greatest ``newest`` of all smaller keys, NULL for the first.

    Keys are grouped by their upper bits, level by level, so that no window holds more than 2^16 rows whatever the
    number of keys: a key looks at the smaller ones of its group, and its group at the smaller groups.
    """
    group = F.shiftright("key", _GROUP_BITS) if level else F.lit(0).cast("bigint")
    grouped = newest.withColumn("_group", group)
    smaller = Window.partitionBy("_group").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    within = grouped.select("key", "_group", F.max("newest").over(smaller).alias("_within"))
    if not level:
        return within.select("key", F.col("_within").alias("before"))
    groups = grouped.groupBy(F.col("_group").alias("key")).agg(F.max("newest").alias("newest"))
    above = _newest_before(groups, level - 1).select(F.col("key").alias("_group"), F.col("before").alias("_above"))
    return within.join(above, "_group").select("key", F.greatest("_within", "_above").alias("before"))


def batch_watermarks(transactions: DataFrame, batch: str, out_of_orderness_ms: int) -> DataFrame:
    """``batch, watermark_ms``: the newest event time of all earlier batches less the allowed disorder.

    Rows combine to one per batch before anything is ordered.
    """
    numbered = transactions.where(F.col(batch).isNotNull())
    newest = numbered.groupBy(F.col(batch).cast("bigint").alias("key")).agg(F.max("ts_ms").alias("newest"))
    return _newest_before(newest).select(
        F.col("key").alias(batch), (F.col("before") - out_of_orderness_ms).alias("watermark_ms")
    )


def partition_watermarks(
    transactions: DataFrame, batch: str, partition: str, arrived: str, out_of_orderness_ms: int, idle_ms: int
) -> DataFrame:
    """``batch, watermark_ms``: the least of the partitions' newest event times before each batch, less the allowed disorder.

    ``arrived`` is the time in milliseconds at which a batch came in, the same for all of its rows.  A partition without rows
    for ``idle_ms`` is idle and left out until rows come again; one that has had none yet counts from the first batch
    on, so it holds the watermark back until it is idle.  The watermark never moves back, and stays while all
    partitions are idle.  Every batch of the input gets a row; NULL means that nothing is late yet.

    Rows combine to one for each batch and partition, a report.  It is good until the partition's next batch and for
    ``idle_ms`` at most, so it meets only the batches of the two spans of that length that it touches.  A window holds the
    reports of one partition; nothing holds those of all.
    """
    numbered = transactions.where(F.col(batch).isNotNull())
    reports = numbered.groupBy(F.col(batch).cast("bigint").alias("batch"), F.col(partition).alias("part")).agg(
        F.max("ts_ms").alias("newest"), F.max(arrived).alias("at")
    )
    steps = reports.groupBy("batch").agg(F.max("at").alias("time"))
    first = steps.agg(F.min("time").alias("opened"), F.min("batch").alias("opening"))
    opening = reports.select("part").distinct().crossJoin(F.broadcast(first))  # one row on the right
    silent = opening.select(
        (F.col("opening") - 1).alias("batch"), "part", F.lit(None).cast("bigint").alias("newest"), F.col("opened").alias("at")
    )
    turns = Window.partitionBy("part").orderBy("batch")
    held = (
        reports.unionByName(silent)
        .withColumn("most", F.max("newest").over(turns.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("until", F.lead("batch").over(turns))
        .select("batch", "until", "most", "at", F.explode(F.array((F.col("at") / idle_ms).cast("bigint"), (F.col("at") / idle_ms).cast("bigint") + 1)).alias("span"))
    )
    placed = steps.select(F.col("batch").alias("step"), "time", (F.col("time") / idle_ms).cast("bigint").alias("span"))
    active = placed.join(held, "span").where(
        (F.col("step") > F.col("batch")) & (F.col("until").isNull() | (F.col("step") <= F.col("until"))) & (F.col("time") - F.col("at") < idle_ms)
    )
    least = active.groupBy(F.col("step").alias("key")).agg(
        F.when(F.count("most") == F.count("*"), F.min("most")).alias("newest")
    )
    known = steps.select(F.col("batch").alias("key")).join(least, "key", "left")
    so_far = _newest_before(known).join(known, "key")
    return so_far.select(F.col("key").alias(batch), (F.greatest("before", "newest") - out_of_orderness_ms).alias("watermark_ms"))


def with_partition_lateness(
    transactions: DataFrame,
    batch: str,
    partition: str,
    arrived: str,
    out_of_orderness_ms: int,
    idle_ms: int,
    allowed_ms: int = 0,
) -> DataFrame:
    """Adds ``watermark_ms`` and ``lateness`` as ``with_lateness`` does, with one watermark a partition."""
    marks = partition_watermarks(transactions, batch, partition, arrived, out_of_orderness_ms, idle_ms)
    return transactions.join(marks, batch, "left").withColumn("lateness", lateness(F.col("ts_ms"), F.col("watermark_ms"), allowed_ms))


def with_lateness(
    transactions: DataFrame, batch: str, out_of_orderness_ms: int, allowed_ms: int = 0
) -> DataFrame:
    """Adds ``watermark_ms`` and ``lateness`` for rows that arrived in numbered batches.

    A row without a batch number has no watermark and is on time.  Spark broadcasts the marks if they are small, and
    otherwise splits a batch with very many rows as a skewed join.
    """
    marks = batch_watermarks(transactions, batch, out_of_orderness_ms)
    return transactions.join(marks, batch, "left").withColumn(
        "lateness", lateness(F.col("ts_ms"), F.col("watermark_ms"), allowed_ms)
    )
