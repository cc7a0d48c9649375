"""The stateful part of the streaming form, as one streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import model as m
from riskloom.config import EngineConfig
from riskloom.streaming.processors import (
    CARRIED,
    CARRIED_ROW,
    EVALUATED_PARTS,
    EVALUATED_SCHEMA,
    EVALUATED_TEXT,
    UNIQUE_SCHEMA,
    FirstOccurrence,
    InEventOrder,
)

_ID_BUCKETS = 512  # state keys of the duplicates; a batch of four million ids brings eight thousand to each
_NEVER_LATE = "2262-04-01 00:00:00"  # near the end of what pandas timestamps hold


def _text() -> Column:
    """A carried row as one text."""
    # Times go as microseconds: the nanoseconds of pandas end in the year 2262.
    return F.to_json(F.struct(*[F.unix_micros(c).alias(c) if c == "timestamp" else F.col(c) for c in CARRIED]))


def _read(text: str, schema: T.StructType) -> Column:
    """The parts of a text, as columns. A one-row generator: the text is read once, not for each column."""
    return F.inline(F.array(F.from_json(text, schema)))


def unique_stream(transactions: DataFrame, retention_ms: int) -> DataFrame:
    """First occurrence per id within the retention, in processing time."""
    rows = (
        transactions.select("transaction_id", *m.COORDINATES, _text().alias("row"))
        .withColumn("bucket", F.pmod(F.xxhash64("transaction_id"), F.lit(_ID_BUCKETS)))
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=FirstOccurrence(retention_ms),
            outputStructType=UNIQUE_SCHEMA,
            outputMode="Append",
            timeMode="ProcessingTime",
        )
    )
    return rows.select(_read("row", CARRIED_ROW)).withColumn("timestamp", F.timestamp_micros("timestamp"))


def _never_late() -> Column:
    """A constant event-time column.

    Spark marks event-time columns by this metadata key and does not allow a second ``withWatermark`` in a query with
    several stateful operators, so the mark is set here.  A test fails if late rows ever stop coming through.
    """
    far = F.lit(_NEVER_LATE).cast("timestamp")
    return far.alias("never_late", metadata={"spark.watermarkDelayMs": 0})


def evaluated_stream(unique: DataFrame, config: EngineConfig) -> DataFrame:
    """Rows with their context and ``lateness``, in event-time order per customer.

    Spark drops rows behind the watermark before a stateful operator sees them, judged by the event-time column in the
    operator's input.  Late rows must come out here, so the input carries another event-time column instead, one that is
    never behind; see ``_never_late``.  The watermark still follows the real event time.
    """
    marked = (
        unique.withColumn("event_time", F.col("timestamp"))
        .withWatermark("event_time", f"{config.out_of_orderness_seconds} seconds")
        .select("customer_id", _text().alias("row"), _never_late())
    )
    # By rows: a customer has few in a batch, and a pandas frame for each call costs more than all else.
    rows = marked.groupBy("customer_id").transformWithState(
        statefulProcessor=InEventOrder(
            config.allowed_lateness_seconds * 1_000, config.history_retention_ms, config.history_max_entries
        ),
        outputStructType=EVALUATED_TEXT,
        outputMode="Append",
        timeMode="EventTime",
    )
    parts = rows.select(_read("evaluated", EVALUATED_PARTS)).select("row.*", "context.*", "lateness")
    return parts.select(*EVALUATED_SCHEMA.names).withColumn("timestamp", F.timestamp_micros("timestamp"))
