"""Named queries over the test tables, one or more per operator.  Each reads the whole ``events`` table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import model as m
from riskloom.config import EngineConfig
from riskloom.functions.instants import format_instant
from riskloom.operators.counters import duplicates_dropped, message_counts, outcome_metrics
from riskloom.operators.dedup import first_per_transaction
from riskloom.operators.flush import flush_batches
from riskloom.operators.lateness import partition_watermarks, with_lateness, with_partition_lateness
from riskloom.operators.parse import parse_messages
from riskloom.operators.route import (
    alert_records,
    dead_letter_records,
    persistable_of,
    risk_result_records,
    score_rows,
    transaction_rows,
)
from riskloom.operators.score import high_risk_alerts, with_score
from riskloom.operators.slices import with_history_at_scale
from riskloom.operators.validate import dead_letters, valid_transactions
from riskloom.plans import streams
from riskloom.plans.assemble import checked_messages, evaluated
from riskloom.rules import risk as risk_rule_classes
from riskloom.rules import validation as validation_rule_classes
from riskloom.rules.registry import risk_rules, validation_rules
from riskloom.rules.validation import invariant_violations
from riskloom.sinks.constraints import split_rejected
from riskloom.sinks.first_write import new_alerts, new_rows
from riskloom.sinks.id_index import IdIndex
from riskloom.sinks.ledger import FileLedger
from riskloom.session import shared_folder, staged
from riskloom.sources.tables import events_as_messages, events_as_transactions, read_events

Query = Callable[[SparkSession, str], DataFrame]

STRICT_SETTINGS = {
    "risk.anomaly-multiplier": "2.5",
    "risk.anomaly-min-history": "5",
    "risk.max-declined-per-five-minutes": "2",
    "risk.impossible-travel-minutes": "3",
    "risk.new-country-amount-multiplier": "1.5",
    "risk.new-country-min-history": "2",
    "risk.max-amount-per-ten-minutes": "2500.50",
    "risk.max-transactions-per-minute": "3",
}


def _transactions(spark: SparkSession, sf_dir: str, compression: int = 1_000) -> DataFrame:
    return events_as_transactions(read_events(spark, sf_dir), compression=compression)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_messages(read_events(spark, sf_dir))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_history_at_scale(_transactions(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str, settings: dict[str, str] | None = None) -> DataFrame:
    return with_score(_contexts(spark, sf_dir), risk_rules(settings, built_in=True))


def _coordinates() -> list[Column]:
    return [F.col("partition"), F.col("offset")]


def _double(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


def _joined(name: str) -> Column:
    return F.array_join(name, ",").alias(name)


# Parsing and validation


def parsed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_messages(_messages(spark, sf_dir))
    return parsed.where(F.col("error").isNull()).select(
        *_coordinates(),
        "transaction_id",
        "customer_id",
        "merchant_id",
        _double("amount"),
        "currency",
        "country",
        "ts_ms",
        "payment_status",
    )


def malformed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_messages(_messages(spark, sf_dir))
    return parsed.where(F.col("error").isNotNull()).select("topic", *_coordinates(), "error", "payload")


def _exploded(parsed: DataFrame, found: Column) -> DataFrame:
    rows = parsed.where(F.col("error").isNull()).select(*_coordinates(), F.posexplode(found).alias("position", "v"))
    return rows.select(*_coordinates(), "position", F.col("v.code").alias("code"), F.col("v.message").alias("message"))


def all_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(checked_messages(_messages(spark, sf_dir)), F.col("violations"))


def invariant_violation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(parse_messages(_messages(spark, sf_dir)), invariant_violations())


def _one_rule(rule_class) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _exploded(
            parse_messages(_messages(spark, sf_dir)), rule_class().violations(F.current_timestamp())
        )

    return query


def _check_digits(columns: dict) -> list[list[tuple[str, str]]]:
    """A rule that fails on ids ending in 7 or 57 and finds fault with those ending in 8 or 58."""
    found = []
    for transaction_id in columns["transaction_id"].to_pylist():
        last = int(transaction_id) % 50 if transaction_id and transaction_id.strip() else 0
        if last == 7:
            raise ValueError(f"no check digit for {transaction_id}")
        found.append([("CHECK_DIGIT", f"check digit of {transaction_id} is {last}")] if last == 8 else [])
    return found


def rule_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = validation_rule_classes.ColumnValidationRule("CheckDigitRule", ["transaction_id"], _check_digits)
    return _exploded(checked_messages(_messages(spark, sf_dir), validation_rules([rule])), F.col("violations"))


def lossy_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message that is no JSON, with bytes behind it that are no text."""
    messages = _messages(spark, sf_dir)
    junk = F.when(F.col("offset") % 4 < 2, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("20C3")))
    broken = messages.withColumn("value", F.concat("value", junk)).where(F.contains(F.col("value"), F.lit("not json").cast("binary")))
    parsed = parse_messages(broken)
    return parsed.select(*_coordinates(), "error", "payload")


def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = valid_transactions(checked_messages(_messages(spark, sf_dir)))
    return valid.select(*_coordinates(), "transaction_id", "customer_id", _double("amount"), "ts_ms")


def dead_letter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letters(checked_messages(_messages(spark, sf_dir))).drop("detected_at")


def message_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_counts(checked_messages(_messages(spark, sf_dir)))


def unique_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = valid_transactions(checked_messages(_messages(spark, sf_dir)))
    return first_per_transaction(valid).select("transaction_id", *_coordinates(), "customer_id", _double("amount"))


def duplicate_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates_dropped(valid_transactions(checked_messages(_messages(spark, sf_dir))))


# History


def _feature(*columns: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(_contexts(spark, sf_dir), *columns)

    return query


def _shown(contexts: DataFrame, *columns: str) -> DataFrame:
    shapes = {
        "amount_last_ten_minutes": _double("amount_last_ten_minutes"),
        "average_recent_amount": _double("average_recent_amount"),
        "recent_countries": _joined("recent_countries"),
        "known_countries": F.array_join(F.array_sort("known_countries"), ",").alias("known_countries"),
    }
    return contexts.select("transaction_id", *[shapes.get(c, F.col(c)) for c in columns])


def _dense_history(compression: int) -> Query:
    """Twenty customers only, so that their histories are long."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        few = _transactions(spark, sf_dir, compression).withColumn(
            "customer_id", (F.col("customer_id").cast("bigint") % 20).cast("string")
        )
        return _shown(with_history_at_scale(few), *m.CONTEXT_COLUMNS)

    return query


# Rules, scores and alerts


def _triggered(rule_class) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        contribution = rule_class().contribution()
        return _contexts(spark, sf_dir).select(
            "transaction_id", contribution["score"].alias("score"), contribution["reason"].alias("reason")
        )

    return query


def _results(settings: dict[str, str] | None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scored(spark, sf_dir, settings).select(
            "transaction_id", "customer_id", "risk_score", "risk_level", _joined("reasons"), "ts_ms"
        )

    return query


class EvenCustomer:
    """A rule as an installed package would bring it."""

    name = "even-customer"

    def __init__(self) -> None:
        self.points = 15

    def configure(self, settings) -> None:
        self.points = int(settings.get("risk.even-customer-points", self.points))

    def contribution(self) -> Column:
        even = F.col("customer_id").cast("bigint") % 2 == 0
        return F.when(even, F.struct(F.lit(self.points).alias("score"), F.lit("EVEN_CUSTOMER").alias("reason"))).otherwise(
            F.struct(F.lit(0).alias("score"), F.lit(None).cast("string").alias("reason"))
        )


def extended_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with one more rule, which takes its place among the others by name and its points from the settings."""
    rules = risk_rules({"risk.even-customer-points": "35"}, [EvenCustomer()], built_in=True)
    scored = with_score(_contexts(spark, sf_dir), rules)
    return scored.select("transaction_id", "risk_score", "risk_level", _joined("reasons"))


def risk_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("risk_level").agg(F.count(F.lit(1)).alias("transactions"))


def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = _scored(spark, sf_dir).select(F.explode("reasons").alias("reason"))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("transactions"))


def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = high_risk_alerts(_scored(spark, sf_dir))
    time = F.unix_millis("transaction_timestamp").alias("transaction_ts_ms")
    return alerts.select(
        "alert_id", "transaction_id", "customer_id", "risk_score", "risk_level", _joined("reasons"), time
    )


def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages through parsing, validation, deduplication and scoring."""
    valid = valid_transactions(checked_messages(_messages(spark, sf_dir)))
    scored = evaluated(valid, EngineConfig(), risk_rules())
    return scored.select("transaction_id", "customer_id", "risk_score", "risk_level", _joined("reasons"))


# Lateness, routing and tables


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh event arrives three batches after its turn."""
    tx = _transactions(spark, sf_dir)
    event_id = F.col("transaction_id").cast("bigint")
    turn = F.floor(event_id / F.lit(1_000).cast("decimal(4,0)")).cast("bigint")
    return tx.withColumn("arrival_batch", turn + F.when(event_id % 7 == 0, F.lit(3)).otherwise(F.lit(0)))


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = with_lateness(_arrivals(spark, sf_dir), "arrival_batch", 30_000, 120_000)
    return marked.select("transaction_id", "arrival_batch", "watermark_ms", "lateness")


def _partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of a hundred turns every four seconds from four partitions: one runs two batches behind, one falls silent
    for 48 seconds again and again."""
    event_id = F.col("transaction_id").cast("bigint")
    turn = F.floor(event_id / F.lit(100).cast("decimal(3,0)")).cast("bigint")
    silent = (F.floor(turn / F.lit(12).cast("decimal(2,0)")).cast("bigint") % 2 == 1) & (event_id % 4 == 3)
    placed = _transactions(spark, sf_dir).withColumn("source", F.when(silent, 0).otherwise(event_id % 4).cast("int"))
    batch = turn + F.when(F.col("source") == 2, 2).otherwise(0)
    return placed.withColumn("arrival_batch", batch).withColumn("arrived_ms", F.col("arrival_batch") * 4_000)


def partition_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_watermarks(_partitioned(spark, sf_dir), "arrival_batch", "source", "arrived_ms", 30_000, 30_000)


def partition_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = with_partition_lateness(_partitioned(spark, sf_dir), "arrival_batch", "source", "arrived_ms", 5_000, 30_000, 20_000)
    return marked.select("transaction_id", "arrival_batch", "source", "watermark_ms", "lateness")


def _tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All arrivals evaluated with two minutes of allowed lateness: scored in event-time order, or LATE."""
    arrivals = _arrivals(spark, sf_dir).withColumns(
        {"topic": F.lit("transaction.events"), "partition": F.lit(0), "offset": F.col("transaction_id").cast("bigint")}
    )
    config = EngineConfig(allowed_lateness_seconds=120)
    return evaluated(arrivals, config, risk_rules(), arrival_batch="arrival_batch")


def tolerated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    tolerated = _tolerant(spark, sf_dir).where(F.col("lateness") == "TOLERATED")
    return tolerated.select("transaction_id", "risk_score", "risk_level", _joined("reasons"))


def outcome_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tolerant(spark, sf_dir).agg(*outcome_metrics())


def unique_by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event also arrives a second time, with smaller coordinates, in an earlier or a later batch."""
    tx = _arrivals(spark, sf_dir)
    event_id = F.col("transaction_id").cast("bigint")
    first = tx.withColumns({"partition": F.lit(1), "offset": event_id})
    again = tx.withColumns(
        {"partition": F.lit(0), "offset": event_id, "arrival_batch": F.col("arrival_batch") + F.when(event_id % 3 == 0, -1).otherwise(1)}
    )
    rows = first.unionByName(again)
    kept = first_per_transaction(rows, ["arrival_batch", "partition", "offset"])
    return kept.select("transaction_id", "arrival_batch", "partition")


def persistable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrivals = _arrivals(spark, sf_dir).withColumns(
        {"topic": F.lit("transaction.events"), "partition": F.lit(0), "offset": F.col("transaction_id").cast("bigint")}
    )
    tagged = evaluated(arrivals, EngineConfig(), risk_rules(), arrival_batch="arrival_batch")
    return persistable_of(tagged).select(
        "transaction_id", "status", "risk_score", "risk_level", _joined("reasons"), "raise_alert"
    )


def _text_record(records: DataFrame) -> DataFrame:
    return records.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def risk_result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_record(risk_result_records(_scored(spark, sf_dir)))


def alert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_record(alert_records(high_risk_alerts(_scored(spark, sf_dir))))


def dead_letter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    detected_at = F.lit("2027-03-02T08:20:07Z").cast("timestamp")
    return _text_record(dead_letter_records(dead_letters(checked_messages(_messages(spark, sf_dir)), detected_at)))


def _events_to_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_persist(_contexts(spark, sf_dir))


def _to_persist(contexts: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    scored = with_score(contexts, risk_rules(settings, built_in=True)).withColumn("lateness", F.lit("ON_TIME"))
    scored = scored.withColumns({"topic": F.lit("t"), "partition": F.lit(0), "offset": F.lit(0).cast("bigint")})
    return persistable_of(scored)


def _stored_shape(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_time", format_instant(F.col("event_time"))).drop("created_at")


def stored_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transaction_rows(_events_to_persist(spark, sf_dir), F.current_timestamp())
    return _stored_shape(rows).withColumn("amount", F.col("amount").cast("double"))


def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_rows(_events_to_persist(spark, sf_dir), F.current_timestamp())
    return _stored_shape(rows).withColumn("risk_score", F.col("risk_score").cast("int"))


def rejected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with values that the tables refuse, by kind."""
    event_id = F.col("transaction_id").cast("bigint")
    odd = (
        _events_to_persist(spark, sf_dir)
        .withColumn("country", F.when(event_id % 11 == 0, F.lit("PRT")).otherwise(F.col("country")))
        .withColumn("currency", F.when(event_id % 13 == 0, F.lit("EURO")).otherwise(F.lit("EU ")))
        .withColumn("merchant_id", F.when(event_id % 17 != 0, F.col("merchant_id")))
        .withColumn(
            "amount",
            F.when(event_id % 19 == 0, F.lit("999999999999999.99995").cast(m.MONEY)).otherwise(F.col("amount")),
        )
        .withColumn("customer_id", F.when(event_id % 23 == 0, F.repeat("customer_id", 101)).otherwise(F.col("customer_id")))
    )
    _, rejected = split_rejected(odd)
    return rejected.select("transaction_id", "rejection")


def _replay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A replay of all events, and the tables of an earlier run with stricter rules that stored two of three events.

    The history is computed once; both rule sets are applied to it.
    """
    contexts = staged(_contexts(spark, sf_dir), "contexts")
    earlier = _to_persist(contexts, STRICT_SETTINGS).where(F.col("transaction_id").cast("bigint") % 3 != 0)
    now = F.current_timestamp()
    return _to_persist(contexts), transaction_rows(earlier, now), score_rows(earlier, now)


def flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of 500 rows or 200 ms. Two thirds of the rows come in by one writer, in a few seconds, so that both limits bind."""
    event_id = F.col("transaction_id").cast("bigint")
    writer = F.when(event_id % 3 != 0, "hot").otherwise(F.concat(F.lit("w"), (F.col("customer_id").cast("bigint") % 5).cast("string")))
    rows = _transactions(spark, sf_dir, 1_000_000).select(writer.alias("writer"), "ts_ms", event_id.alias("event_id"))
    return flush_batches(rows, "writer", "ts_ms", "event_id", slice_rows=5_000)


def first_write_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``risk_scores`` after a replay of all events onto an earlier partial write."""
    replay, transactions, scores = _replay(spark, sf_dir)
    _, added = new_rows(replay, transactions, scores, F.current_timestamp())
    return scores.unionByName(added).select("transaction_id", F.col("risk_score").cast("int").alias("risk_score"), "risk_level", "reasons")


def ledger_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ledger counts: two of three events, then a replay of all; every nineteenth amount fits no table."""
    contexts = staged(_contexts(spark, sf_dir), "contexts")
    event_id = F.col("transaction_id").cast("bigint")
    too_much = F.lit("999999999999999.99995").cast(m.MONEY)
    events = _to_persist(contexts).withColumn("amount", F.when(event_id % 19 == 0, too_much).otherwise(F.col("amount")))
    events = staged(events, "events")
    ledger = FileLedger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}", index_buckets=8)
    ledger.write(events.where(event_id % 3 != 0), 0)
    ledger.write(events, 1)
    c = ledger.counters
    counted = {"batches_written": c.batches_written, "rows_written": c.rows_written, "records_skipped": c.records_skipped}
    stored = ledger.read("transactions").agg(F.count("*").alias("rows_stored"), F.count_distinct("transaction_id").alias("ids_stored"))
    return stored.select(*[F.lit(v).cast("bigint").alias(k) for k, v in counted.items()], "rows_stored", "ids_stored")


def indexed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``risk_scores`` after the same replay, where an index over three earlier batches tells which ids are stored."""
    replay, transactions, scores = _replay(spark, sf_dir)
    index = IdIndex(spark, f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}", buckets=16)
    for batch in range(3):
        index.add(transactions.where(F.pmod(F.xxhash64("transaction_id"), F.lit(3)) == batch), batch)
    known = index.known(replay, 3)
    _, added = new_rows(replay, known, known, F.current_timestamp())
    return scores.unionByName(added).select("transaction_id", F.col("risk_score").cast("int").alias("risk_score"), "risk_level", "reasons")


def first_write_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fraud_alerts`` after the same replay: only alerts that agree with the score on record."""
    replay, transactions, scores = _replay(spark, sf_dir)
    _, added = new_rows(replay, transactions, scores, F.current_timestamp())
    on_record = scores.unionByName(added)
    none_yet = on_record.where(F.lit(False))
    alerts = new_alerts(replay, on_record, none_yet, F.current_timestamp())
    return alerts.select("transaction_id", F.col("risk_score").cast("int").alias("risk_score"), "risk_level", "reasons")


def catalog() -> dict[str, Query]:
    rules = risk_rule_classes
    checks = validation_rule_classes
    return {
        "parsed_messages": parsed_messages,
        "malformed_messages": malformed_messages,
        "all_violations": all_violations,
        "invariant_violations": invariant_violation_rows,
        "minimum_amount_violations": _one_rule(checks.MinimumAmountRule),
        "required_field_violations": _one_rule(checks.RequiredFieldsRule),
        "supported_currency_violations": _one_rule(checks.SupportedCurrencyRule),
        "rule_errors": rule_error_rows,
        "lossy_payloads": lossy_payloads,
        "valid_transactions": valid_rows,
        "dead_letters": dead_letter_rows,
        "message_counters": message_counters,
        "unique_transactions": unique_transactions,
        "duplicate_counter": duplicate_counter,
        "transactions_last_minute": _feature("transactions_last_minute"),
        "amount_last_ten_minutes": _feature("amount_last_ten_minutes"),
        "previous_transaction": _feature("previous_country", "time_since_previous_ms"),
        "recent_countries": _feature("recent_countries"),
        "average_recent_amount": _feature("average_recent_amount", "recent_transaction_count"),
        "known_countries": _feature("known_countries"),
        "declined_last_five_minutes": _feature("declined_last_five_minutes"),
        "risk_context": _feature(*m.CONTEXT_COLUMNS),
        "bounded_history": _dense_history(1_000),
        "retained_history": _dense_history(100),
        "rule_amount_anomaly": _triggered(rules.AmountAnomaly),
        "rule_failed_attempts": _triggered(rules.FailedAttemptsThenSuccess),
        "rule_geographic_impossibility": _triggered(rules.GeographicImpossibility),
        "rule_new_country": _triggered(rules.NewCountryHighAmount),
        "rule_spending_velocity": _triggered(rules.SpendingVelocity),
        "rule_transaction_velocity": _triggered(rules.TransactionVelocity),
        "risk_results": _results(None),
        "risk_results_strict": _results(STRICT_SETTINGS),
        "extended_results": extended_results,
        "risk_level_counts": risk_level_counts,
        "reason_counts": reason_counts,
        "high_risk_alerts": alert_rows,
        "end_to_end_results": end_to_end,
        "late_transactions": late_rows,
        "partition_watermarks": partition_marks,
        "partition_lateness": partition_lateness,
        "tolerated_results": tolerated_results,
        "outcome_counters": outcome_counters,
        "unique_by_arrival": unique_by_arrival,
        "persistable_events": persistable_rows,
        "risk_result_documents": risk_result_documents,
        "alert_documents": alert_documents,
        "dead_letter_documents": dead_letter_documents,
        "stored_transactions": stored_transactions,
        "stored_scores": stored_scores,
        "rejected_records": rejected_records,
        "flush_batches": flushed,
        "first_write_scores": first_write_scores,
        "first_write_alerts": first_write_alerts,
        "indexed_first_write_scores": indexed_scores,
        "ledger_counters": ledger_counters,
        "log_records": streams.log_records,
        "stream_results": streams.stream_results,
        "stream_state": streams.stream_state,
    }
