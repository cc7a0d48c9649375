"""Splits customers with very many rows, so that one customer never decides the length of a stage.

A history reaches back at most ``max_entries`` rows.  A customer's ordered rows can therefore be cut into slices of equal
length, provided each slice also receives the last ``max_entries`` rows of the slice before it (the *halo*).  Halo rows
only serve as history and are dropped afterwards.  Cutting by position works for any distribution of times, also when
many rows share one instant.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import model as m
from riskloom.operators.history import with_history
from riskloom.session import enable_checkpoints

ROWS_PER_SLICE = 1_000_000


@dataclass(frozen=True)
class SkewLimits:
    """A customer is hot above ``rows_per_slice`` rows, whatever the size of the input.

    There can be as many hot customers as the input has slices, so their list is joined, and Spark broadcasts it only if
    its size allows.
    """

    rows_per_slice: int = ROWS_PER_SLICE


def hot_customers(transactions: DataFrame, limits: SkewLimits = SkewLimits()) -> DataFrame | None:
    """``customer_id, customer_rows`` of the hot customers, or None.  Reads one column; counts combine before the shuffle."""
    counts = transactions.groupBy("customer_id").agg(F.count(F.lit(1)).alias("customer_rows"))
    most = counts.agg(F.max("customer_rows")).first()[0]
    if most is None or most <= limits.rows_per_slice:
        return None
    return counts.where(F.col("customer_rows") > limits.rows_per_slice)


def sliced(hot_rows: DataFrame, total_rows: int, max_entries: int, rows_per_slice: int) -> DataFrame:
    """Adds ``_slice`` and ``_halo`` to the rows of hot customers and repeats the halo rows."""
    spark = hot_rows.sparkSession
    enable_checkpoints(spark)
    length = max(rows_per_slice, max_entries)
    parts = max(2, -(-total_rows // length))
    # Range partitioning spreads one customer over many partitions.  The checkpoint pins the partition numbers: later
    # stages and retries must see the same ones.
    ranged = (
        hot_rows.repartitionByRange(parts, "customer_id", "ts_ms", "transaction_id")
        .withColumn("_part", F.spark_partition_id())
        .checkpoint()
    )
    part_rows = ranged.groupBy("customer_id", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("customer_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per partition plus one per hot customer: a partition range is contiguous.
    offsets = part_rows.select(
        "customer_id", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    in_part = Window.partitionBy("customer_id", "_part").orderBy("ts_ms", "transaction_id")
    placed = (
        ranged.withColumn("_rank", F.row_number().over(in_part))
        .join(offsets, ["customer_id", "_part"])
        .withColumn("_at", F.col("_before") + F.col("_rank") - 1)
    )
    own = F.floor(F.col("_at") / F.lit(length).cast("decimal(18,0)")).cast("bigint")
    feeds_next = F.col("_at") % length >= length - max_entries
    copies = F.when(
        feeds_next,
        F.array(
            F.struct(own.alias("slice"), F.lit(False).alias("halo")),
            F.struct((own + 1).alias("slice"), F.lit(True).alias("halo")),
        ),
    ).otherwise(F.array(F.struct(own.alias("slice"), F.lit(False).alias("halo"))))
    return (
        placed.withColumn("_copy", F.explode(copies))
        .withColumn("_slice", F.col("_copy.slice"))
        .withColumn("_halo", F.col("_copy.halo"))
        .drop("_part", "_rank", "_before", "_at", "_copy")
    )


def with_history_at_scale(
    transactions: DataFrame,
    *,
    retention_ms: int = m.HISTORY_RETENTION_MS,
    max_entries: int = m.HISTORY_MAX_ENTRIES,
    limits: SkewLimits = SkewLimits(),
) -> DataFrame:
    """``with_history`` for any distribution of rows over customers.

    Counts rows per customer first.  Without a hot customer the plan is the plain one; otherwise hot customers are cut
    into slices and all rows go through the same windows, partitioned by customer and slice.
    """
    hot = hot_customers(transactions, limits)
    if hot is None:
        return with_history(transactions, retention_ms=retention_ms, max_entries=max_entries)
    hot_total = hot.agg(F.sum("customer_rows")).first()[0]
    hot_ids = hot.select("customer_id")
    calm = (
        transactions.join(hot_ids, "customer_id", "left_anti")
        .withColumn("_slice", F.lit(0).cast("bigint"))
        .withColumn("_halo", F.lit(False))
    )
    busy = sliced(
        transactions.join(hot_ids, "customer_id", "left_semi"), hot_total, max_entries, limits.rows_per_slice
    )
    both = calm.unionByName(busy)
    history = with_history(
        both, retention_ms=retention_ms, max_entries=max_entries, keys=("customer_id", "_slice")
    )
    return history.where(~F.col("_halo")).select(*transactions.columns, *m.CONTEXT_COLUMNS)
