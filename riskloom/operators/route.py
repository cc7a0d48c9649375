"""Shapes of the outputs: persistable rows, table rows and JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import model as m
from riskloom.functions.instants import format_instant
from riskloom.operators.score import is_alert


def processed_to_persist(scored: DataFrame) -> DataFrame:
    """A scored transaction with status PROCESSED and the decision whether to raise an alert."""
    return scored.select(
        *m.TRANSACTION_COLUMNS,
        *[c for c in m.COORDINATES if c in scored.columns],
        F.lit(m.STATUS_PROCESSED).alias("status"),
        F.col("risk_score").cast("int").alias("risk_score"),
        "risk_level",
        "reasons",
        is_alert(F.col("risk_level")).alias("raise_alert"),
    )


def late_to_persist(late: DataFrame) -> DataFrame:
    """A late transaction with status LATE: no risk and no alert."""
    return late.select(
        *m.TRANSACTION_COLUMNS,
        *[c for c in m.COORDINATES if c in late.columns],
        F.lit(m.STATUS_LATE).alias("status"),
        F.lit(None).cast("int").alias("risk_score"),
        F.lit(None).cast("string").alias("risk_level"),
        F.lit(None).cast("array<string>").alias("reasons"),
        F.lit(False).alias("raise_alert"),
    )


def persistable_of(tagged: DataFrame) -> DataFrame:
    """Scored and late rows of one frame in one pass; late rows have neither risk nor alert."""
    late = F.col("lateness") == "LATE"
    return tagged.select(
        *m.TRANSACTION_COLUMNS,
        *[c for c in m.COORDINATES if c in tagged.columns],
        F.when(late, m.STATUS_LATE).otherwise(m.STATUS_PROCESSED).alias("status"),
        F.when(~late, F.col("risk_score").cast("int")).alias("risk_score"),
        F.when(~late, F.col("risk_level")).alias("risk_level"),
        F.when(~late, F.col("reasons")).alias("reasons"),
        (~late & is_alert(F.col("risk_level"))).alias("raise_alert"),
    )


def persistable(scored: DataFrame, late: DataFrame) -> DataFrame:
    return processed_to_persist(scored).unionByName(late_to_persist(late))


def transaction_rows(events: DataFrame, created_at: Column) -> DataFrame:
    """Rows of the ``transactions`` table; a missing payment status means approved."""
    return events.select(
        "transaction_id",
        "customer_id",
        "merchant_id",
        F.col("amount").cast(m.TABLE_MONEY).alias("amount"),
        "currency",
        "country",
        F.col("timestamp").alias("event_time"),
        "status",
        created_at.alias("created_at"),
        F.coalesce("payment_status", F.lit(m.APPROVED)).alias("payment_status"),
    )


def score_rows(events: DataFrame, created_at: Column) -> DataFrame:
    """Rows of the ``risk_scores`` table, for events that were scored; reasons are a JSON array."""
    return events.where(F.col("risk_score").isNotNull()).select(
        "transaction_id",
        "customer_id",
        F.col("risk_score").cast("smallint").alias("risk_score"),
        "risk_level",
        F.to_json("reasons").alias("reasons"),
        F.col("timestamp").alias("event_time"),
        created_at.alias("created_at"),
    )


def _record(key: Column, document: Column) -> list[Column]:
    body = F.to_json(document, {"ignoreNullFields": "false"})
    return [key.cast("binary").alias("key"), body.cast("binary").alias("value")]


def risk_result_records(scored: DataFrame) -> DataFrame:
    """``key, value`` of the risk-result topic, keyed by customer."""
    document = F.struct(
        F.col("transaction_id").alias("transactionId"),
        F.col("customer_id").alias("customerId"),
        F.col("risk_score").alias("riskScore"),
        F.col("risk_level").alias("riskLevel"),
        F.col("reasons"),
        format_instant(F.col("timestamp")).alias("timestamp"),
    )
    return scored.select(*_record(F.col("customer_id"), document))


def alert_records(alerts: DataFrame) -> DataFrame:
    """``key, value`` of the alert topic, keyed by customer so that alerts of one customer stay ordered."""
    document = F.struct(
        F.col("alert_id").alias("alertId"),
        F.col("transaction_id").alias("transactionId"),
        F.col("customer_id").alias("customerId"),
        F.col("risk_score").alias("riskScore"),
        F.col("risk_level").alias("riskLevel"),
        F.col("reasons"),
        format_instant(F.col("transaction_timestamp")).alias("transactionTimestamp"),
    )
    return alerts.select(*_record(F.col("customer_id"), document))


def dead_letter_records(letters: DataFrame) -> DataFrame:
    """``key, value`` of the dead-letter topic; the key is the transaction id, or NULL when it is not known."""
    document = F.struct(
        F.col("source"),
        F.col("code"),
        F.col("detail"),
        F.col("transaction_id").alias("transactionId"),
        F.col("payload"),
        F.col("topic"),
        F.col("partition"),
        F.col("offset"),
        format_instant(F.col("detected_at")).alias("detectedAt"),
    )
    return letters.select(*_record(F.col("transaction_id"), document))
