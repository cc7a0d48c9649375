"""Insert-if-absent by transaction id over three tables: the first write wins everywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import model as m
from riskloom.operators.dedup import first_per_transaction
from riskloom.operators.route import score_rows, transaction_rows


def absent_from(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows whose id is not stored yet.  Only the id column of the stored table is read."""
    return incoming.join(stored.select("transaction_id"), "transaction_id", "left_anti")


def new_rows(
    events: DataFrame,
    stored_transactions: DataFrame,
    stored_scores: DataFrame,
    created_at: Column,
    arrival: Sequence[str] = m.COORDINATES,
) -> tuple[DataFrame, DataFrame]:
    """Rows to append to ``transactions`` and ``risk_scores``."""
    first = first_per_transaction(events, arrival)
    scored_first = first_per_transaction(events.where(F.col("risk_score").isNotNull()), arrival)
    return (
        absent_from(transaction_rows(first, created_at), stored_transactions),
        absent_from(score_rows(scored_first, created_at), stored_scores),
    )


def new_alerts(
    events: DataFrame, scores_on_record: DataFrame, stored_alerts: DataFrame, created_at: Column
) -> DataFrame:
    """Rows to append to ``fraud_alerts``.

    An alert is copied from the score on record, and only when that has the level of the event that raises it.  So an
    alert never contradicts the stored score, also when a replay comes to another result.  ``scores_on_record`` must
    already contain the rows of this write.
    """
    raised = events.where("raise_alert").select("transaction_id", "risk_level").distinct()
    agreeing = scores_on_record.join(raised, ["transaction_id", "risk_level"], "left_semi")
    return absent_from(agreeing, stored_alerts).select(
        "transaction_id", "customer_id", "risk_score", "risk_level", "reasons", "event_time", created_at.alias("created_at")
    )
