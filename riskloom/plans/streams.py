"""Queries that run the streaming form over the whole ``events`` table, as a log that arrives out of order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import EngineConfig
from riskloom.session import shared_folder
from riskloom.sources.segment_log import append_to_log, read_log
from riskloom.sources.tables import events_as_messages, read_events
from riskloom.streaming.replay import Replay, replay, state_of

LOG_PARTITIONS = 4
BATCHES = 10
SEGMENT_ROWS = 100_000
ALLOWED_LATENESS_SECONDS = 300


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def arrival_log(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """Every event as a message of a log, and how many records of a partition make a tenth of it.

    Every seventh event arrives a twentieth of all events behind its turn, every eleventh a fifth.
    """
    messages = events_as_messages(read_events(spark, sf_dir))
    event_id = F.col("offset") * LOG_PARTITIONS + F.col("partition")
    total = (messages.agg(F.max(event_id).alias("most")).first()["most"] or 0) + 1
    delay = F.when(event_id % 11 == 0, total // 5).when(event_id % 7 == 0, total // 20).otherwise(0)
    records = messages.select(F.lit(None).cast("string").alias("key"), "value", "partition", (event_id + delay).alias("turn"), event_id.alias("id"))
    # Each task writes a range of a partition's turns; a commit places its segments in the order of the tasks.
    segments = max(LOG_PARTITIONS, -(-total // SEGMENT_ROWS))
    place = ["partition", "turn", "id"]
    ordered = records.repartitionByRange(segments, *place).sortWithinPartitions(*place)
    path = _new_folder(spark, "arrivals")
    append_to_log(ordered, path, partitions=LOG_PARTITIONS)
    share = LOG_PARTITIONS * BATCHES
    return path, -(-total // share)


def _replayed(spark: SparkSession, sf_dir: str) -> Replay:
    log, most = arrival_log(spark, sf_dir)
    return replay(spark, log, _new_folder(spark, "replay"), most=most, config=EngineConfig(allowed_lateness_seconds=ALLOWED_LATENESS_SECONDS))


def stream_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the stateful streaming operators: rows the watermark has passed, tolerated rows as they arrived, late rows."""
    return _replayed(spark, sf_dir).evaluated.select(
        "transaction_id", "customer_id", "lateness", "risk_score", "risk_level", F.array_join("reasons", ",").alias("reasons"),
        F.col("recent_transaction_count").alias("history_count"),
    )


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the evaluation keeps of each customer after the last batch: waiting rows and history entries."""
    checkpoint = _replayed(spark, sf_dir).checkpoint
    waiting = state_of(spark, checkpoint, "waiting")
    held = waiting.groupBy(F.col("key.customer_id").alias("customer_id")).agg(F.sum(F.size("user_map_value.rows")).alias("waiting"))
    entries = state_of(spark, checkpoint, "history")
    kept = entries.groupBy(F.col("key.customer_id").alias("customer_id")).agg(F.count("*").alias("history"))
    both = held.join(kept, "customer_id", "full")
    return both.select("customer_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("waiting", "history")])


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read back: which message stands at which coordinates."""
    path, _ = arrival_log(spark, sf_dir)
    records = read_log(spark, path)
    return records.select("topic", "partition", "offset", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("payload"))
