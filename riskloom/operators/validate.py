"""Applies the validation rules and splits parsed messages into valid transactions and dead letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import model as m
from riskloom.rules.validation import invariant_violations


def with_violations(parsed: DataFrame, rules: Sequence, evaluated_at: Column | None = None) -> DataFrame:
    """Adds ``violations``: the invariants first, then every rule in order.  NULL where parsing failed."""
    now = F.current_timestamp() if evaluated_at is None else evaluated_at
    found = F.concat(invariant_violations(), *[rule.violations(now) for rule in rules])
    return parsed.withColumn("violations", F.when(F.col("error").isNull(), found))


def valid_transactions(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNull() & (F.size("violations") == 0)).drop("error", "payload", "violations")


def dead_letters(checked: DataFrame, detected_at: Column | None = None) -> DataFrame:
    """One row per message that could not be parsed or broke a rule."""
    malformed = F.col("error").isNotNull()

    def joined(field: str, separator: str) -> Column:
        return F.array_join(F.transform("violations", lambda v: v[field]), separator)

    return checked.where(malformed | (F.size("violations") > 0)).select(
        F.when(malformed, m.SOURCE_DESERIALIZATION).otherwise(m.SOURCE_VALIDATION).alias("source"),
        F.when(malformed, m.MALFORMED_CODE).otherwise(joined("code", ",")).alias("code"),
        F.when(malformed, F.col("error")).otherwise(joined("message", "; ")).alias("detail"),
        F.when(~malformed, F.col("transaction_id")).alias("transaction_id"),
        "payload",
        *m.COORDINATES,
        (F.current_timestamp() if detected_at is None else detected_at).alias("detected_at"),
    )
