"""Counters: as one-row queries, and as metrics observed while a job runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count(condition: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.lit(1))), F.lit(0)).cast("bigint").alias(name)


def row_count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


# Fixed values in the two functions below: metric names.
def message_metrics() -> list[Column]:
    """Over the rows of ``with_violations``."""
    parsed = F.col("error").isNull()
    return [
        _count(parsed & (F.size("violations") == 0), "transactions_valid"),
        _count(parsed & (F.size("violations") > 0), "transactions_rejected"),
        _count(~parsed, "messages_malformed"),
    ]


def outcome_metrics() -> list[Column]:
    """Over the rows of ``evaluated``: scored rows, alerts and both kinds of late rows."""
    late = F.col("lateness") == "LATE"
    return [
        _count(~late, "risk_evaluated"),
        _count(F.col("risk_level") == "HIGH", "high_risk_alerts"),
        _count(late, "late_events"),
        _count(F.col("lateness") == "TOLERATED", "late_events_tolerated"),
    ]


def message_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(*message_metrics())


def duplicates_dropped(before: DataFrame) -> DataFrame:
    """``duplicates_dropped``: rows whose id came before."""
    per_id = before.groupBy("transaction_id").agg((F.count(F.lit(1)) - 1).alias("extra"))
    return per_id.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicates_dropped"))


def observed(df: DataFrame, name: str, metrics: list[Column]) -> DataFrame:
    """Reports the metrics under ``name``: to an ``Observation`` in batch, to query listeners in streaming."""
    return df.observe(name, *metrics)
