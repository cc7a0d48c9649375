"""The whole dataflow: raw messages in, five outputs out.  The same call serves batch and streaming input."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import model as m
from riskloom.config import EngineConfig
from riskloom.operators.counters import observed, row_count
from riskloom.operators.dedup import first_per_transaction
from riskloom.operators.lateness import with_lateness
from riskloom.operators.parse import parse_messages
from riskloom.operators.route import persistable_of
from riskloom.operators.score import high_risk_alerts, with_score
from riskloom.operators.slices import SkewLimits, with_history_at_scale
from riskloom.operators.validate import dead_letters, valid_transactions, with_violations
from riskloom.rules.registry import risk_rules, validation_rules
from riskloom.session import staged


@dataclass(frozen=True)
class Streams:
    """What sinks are attached to."""

    outcomes: DataFrame
    invalid: DataFrame
    late: DataFrame
    persistable: DataFrame
    alerts: DataFrame


def checked_messages(messages: DataFrame, rules: Sequence | None = None) -> DataFrame:
    return with_violations(parse_messages(messages), validation_rules() if rules is None else rules)


def evaluated(
    valid: DataFrame,
    config: EngineConfig,
    rules: Sequence,
    *,
    limits: SkewLimits = SkewLimits(),
    arrival_batch: str | None = None,
    stage: bool = True,
) -> DataFrame:
    """Valid transactions to one tagged DataFrame: scored rows, and LATE rows without a score.

    Batch input counts as complete: no row is late unless ``arrival_batch`` names a column with the number of the batch
    a row arrived in.  Rows within the allowed lateness are then scored in event-time order.
    """
    if valid.isStreaming:
        from riskloom.streaming.risk_stream import evaluated_stream, unique_stream

        arrived = observed(valid, "arrived", [row_count("transactions_arrived")])
        unique = unique_stream(arrived, config.dedup_retention_hours * 3_600_000)
        contexts = evaluated_stream(observed(unique, "unique", [row_count("transactions_unique")]), config)
    else:
        order = m.COORDINATES if arrival_batch is None else (F.col(arrival_batch).asc_nulls_last(), *m.COORDINATES)
        unique = first_per_transaction(valid, order)
        if stage:  # counted, split and scored below: do not parse and shuffle for each of them
            unique = staged(unique, "transactions")
        if arrival_batch is None:
            unique = unique.withColumn("lateness", F.lit("ON_TIME"))
        else:
            unique = with_lateness(
                unique,
                arrival_batch,
                config.out_of_orderness_seconds * 1_000,
                config.allowed_lateness_seconds * 1_000,
            ).drop("watermark_ms")
        in_time = unique.where(F.col("lateness") != "LATE")
        contexts = with_history_at_scale(
            in_time,
            retention_ms=config.history_retention_ms,
            max_entries=config.history_max_entries,
            limits=limits,
        )
        if arrival_batch is not None:
            contexts = contexts.unionByName(unique.where(F.col("lateness") == "LATE"), allowMissingColumns=True)
    return with_score(contexts, rules, F.col("lateness") != "LATE")


def split_outcomes(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored rows, late rows) of ``evaluated``."""
    late = F.col("lateness") == "LATE"
    transaction = [*m.TRANSACTION_COLUMNS, *m.COORDINATES]
    return tagged.where(~late), tagged.where(late).select(*transaction)


def assemble(
    messages: DataFrame,
    config: EngineConfig | None = None,
    *,
    validation: Sequence | None = None,
    risk: Sequence | None = None,
    limits: SkewLimits = SkewLimits(),
    arrival_batch: str | None = None,
    stage: bool = True,
) -> Streams:
    config = config or EngineConfig()
    rules = risk_rules(config.risk_settings) if risk is None else risk
    checked = checked_messages(messages, validation)
    tagged = evaluated(
        valid_transactions(checked), config, rules, limits=limits, arrival_batch=arrival_batch, stage=stage
    )
    if stage and not tagged.isStreaming:  # five outputs start from here
        tagged = staged(tagged, "outcomes")
    outcomes, late = split_outcomes(tagged)
    return Streams(
        outcomes=outcomes,
        invalid=dead_letters(checked),
        late=late,
        persistable=persistable_of(tagged),
        alerts=high_risk_alerts(outcomes),
    )
