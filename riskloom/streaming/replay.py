"""Bounded runs of the streaming form: all that a log holds goes through the stateful operators, batch by batch."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.config import EngineConfig
from riskloom.operators.validate import valid_transactions
from riskloom.plans.assemble import checked_messages, evaluated
from riskloom.rules.registry import risk_rules
from riskloom.sources.log import raw_messages
from riskloom.sources.segment_log import read_log
from riskloom.streaming.job import configure_for_streaming


@dataclass(frozen=True)
class Replay:
    """What a finished run left: the evaluated rows and the query's checkpoint with its state."""

    evaluated: DataFrame
    checkpoint: str


_IDLE_SECONDS = 5.0


def drain(query: StreamingQuery) -> None:
    """Waits until a query has nothing left to do: two batches in a row without new rows.

    The first of them runs the timers up to the last watermark. Spark's own ``processAllAvailable`` does not return here: an
    operator in processing time, as the one for duplicates is, asks for another batch after every batch.
    """
    idle_since = None
    while True:
        if query.exception() is not None or not query.isActive:
            query.awaitTermination()
            return
        done = query.recentProgress[-2:]
        if len(done) == 2 and all(p.numInputRows == 0 for p in done) and done[0].batchId != done[1].batchId:
            return
        status = query.status
        idle = not status["isTriggerActive"] and not status["isDataAvailable"]
        idle_since = (idle_since or time.monotonic()) if idle else None
        if idle_since is not None and time.monotonic() - idle_since > _IDLE_SECONDS:  # no batch at all: nothing was new
            return
        time.sleep(0.1)


@contextmanager
def _few_partitions(spark: SparkSession) -> Iterator[None]:
    """Two state partitions for each core, for a query that starts meanwhile.

    Every micro-batch opens all of them in each operator, which costs about half a second of a core whatever they hold, and
    RocksDB keeps the state of a large one on disk. A query that goes on keeps the number it began with.
    """
    given = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(given), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", given)


def replay(
    spark: SparkSession, log: str, folder: str, *, most: int | None = None, config: EngineConfig | None = None, topic: str = "transaction.events"
) -> Replay:
    """Evaluates the log from where ``folder`` stands to its present end, ``most`` records of a partition a batch.

    ``folder`` keeps checkpoint, position and results, so a run that broke off goes on when it is called again. The file
    sink lists each batch's files once it is done; a repeated batch replaces its own, so no row is written twice.
    Rows that the watermark has not reached stay in the state.
    """
    config = config or EngineConfig()
    configure_for_streaming(spark)
    position = f"{folder}/position" if most is not None else None
    messages = raw_messages(read_log(spark, log, streaming=True, topic=topic, most=most, position=position))
    rows = evaluated(valid_transactions(checked_messages(messages)), config, risk_rules(config.risk_settings))
    results, checkpoint = f"{folder}/results", f"{folder}/checkpoint"
    with _few_partitions(spark):
        query = rows.writeStream.format("parquet").option("path", results).option("checkpointLocation", checkpoint).start()
    try:
        drain(query)
    finally:
        query.stop()
    return Replay(spark.read.schema(rows.schema).parquet(results), checkpoint)


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """Rows of a state variable after the last finished batch, one for each key and entry, of the operator that has it."""
    operators = spark.read.format("state-metadata").load(checkpoint)
    owner = operators.where(operators["operatorProperties"].contains(f'"{variable}"')).select("operatorId").distinct().collect()
    if len(owner) != 1:
        raise ValueError(f"{len(owner)} operators have a state variable {variable}")
    reader = spark.read.format("statestore").option("operatorId", owner[0][0]).option("stateVarName", variable)
    kept = reader.option("flattenCollectionTypes", "true").load(checkpoint)
    if "value" in kept.columns and "entries" in kept.schema["value"].dataType.names:
        return kept.select("key", F.explode(F.from_json("value.entries", "array<string>")).alias("entry"), "partition_id")
    return kept
