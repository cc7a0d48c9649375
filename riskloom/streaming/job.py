"""Runs the dataflow: once over bounded input, or continuously."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from riskloom.config import EngineConfig
from riskloom.operators.counters import message_metrics, observed, outcome_metrics
from riskloom.operators.route import persistable_of
from riskloom.operators.score import high_risk_alerts
from riskloom.operators.validate import dead_letters, valid_transactions
from riskloom.plans.assemble import Streams, assemble, checked_messages, evaluated, split_outcomes
from riskloom.rules.registry import risk_rules
from riskloom.sinks.database import DatabaseSink
from riskloom.sinks.ledger import FileLedger
from riskloom.sinks.retry import RetryPolicy, with_retries
from riskloom.sinks.topics import TopicSinks
from riskloom.sources.segment_log import Folder

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure_for_streaming(spark: SparkSession) -> None:
    """Keyed state on RocksDB with incremental checkpoints."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def run_batch(
    messages: DataFrame,
    config: EngineConfig,
    ledger: FileLedger | DatabaseSink,
    topics: TopicSinks,
    *,
    batch_id: int | None = None,
    validation: Sequence | None = None,
    risk: Sequence | None = None,
) -> Streams:
    """All outputs of bounded input, as a new batch.

    Only the last batch can be repeated, by its ``batch_id``: that replaces its rows and, in file form, its records.
    Earlier ones cannot, as later batches have been compared with them.
    """
    batch_id = ledger.batch_number(batch_id)
    streams = assemble(messages, config, validation=validation, risk=risk)
    _stored(lambda: ledger.write(streams.persistable, batch_id), config, ledger)
    topics.write_results(streams.outcomes, batch_id)
    topics.write_alerts(streams.alerts, batch_id)
    topics.write_dead_letters(streams.invalid, batch_id)
    return streams


def _stored(write: Callable[[], None], config: EngineConfig, ledger: FileLedger | DatabaseSink) -> None:
    def count_retry(attempt: int) -> None:
        ledger.counters.retries += 1

    with_retries(write, RetryPolicy(max_elapsed_s=config.database.max_retry_seconds), on_retry=count_retry)


def _forget(root: str, batch_id: int) -> None:
    """Removes the written outcomes of batches before this one; only the last batch can be repeated."""
    folder = Folder(f"{root}/outcomes")
    for name in folder.names(""):
        if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) < batch_id:
            folder.files.delete_dir(folder.at(name))


@dataclass
class MetricTotals(StreamingQueryListener):
    """Sums the observed counters of all queries of a session."""

    totals: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        super().__init__()

    @property
    def duplicates_dropped(self) -> int:
        return self.totals.get("transactions_arrived", 0) - self.totals.get("transactions_unique", 0)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for row in event.progress.observedMetrics.values():
            for name, value in row.asDict().items():
                self.totals[name] = self.totals.get(name, 0) + (value or 0)


@dataclass(frozen=True)
class RunningJob:
    risk: StreamingQuery
    letters: StreamingQuery

    @property
    def queries(self) -> tuple[StreamingQuery, StreamingQuery]:
        return self.risk, self.letters

    def stop(self) -> None:
        for query in self.queries:
            query.stop()


def start_stream(
    messages: DataFrame,
    config: EngineConfig,
    ledger: FileLedger | DatabaseSink,
    topics: TopicSinks,
    checkpoint: str,
    *,
    validation: Sequence | None = None,
    risk: Sequence | None = None,
    trigger: dict | None = None,
) -> RunningJob:
    """Two queries over the same source: evaluation with its state, and the stateless dead letters.

    Each micro-batch of the evaluation is written once, and all its outputs start from that written table.
    """
    spark = messages.sparkSession
    configure_for_streaming(spark)
    rules = risk_rules(config.risk_settings) if risk is None else risk
    checked = observed(checked_messages(messages, validation), "messages", message_metrics())
    tagged = evaluated(valid_transactions(checked_messages(messages, validation)), config, rules)
    tagged = observed(tagged, "outcomes", outcome_metrics())
    every = trigger or {"processingTime": "10 seconds"}

    def route(batch: DataFrame, batch_id: int) -> None:
        path = f"{ledger.root}/outcomes/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        written = spark.read.schema(batch.schema).parquet(path)
        scored, _ = split_outcomes(written)
        _stored(lambda: ledger.write(persistable_of(written), batch_id), config, ledger)
        topics.write_results(scored, batch_id)
        topics.write_alerts(high_risk_alerts(scored), batch_id)
        _forget(ledger.root, batch_id)

    def route_letters(batch: DataFrame, batch_id: int) -> None:
        topics.write_dead_letters(batch, batch_id)

    risk_query = (
        tagged.writeStream.queryName("risk")
        .foreachBatch(route)
        .option("checkpointLocation", f"{checkpoint}/risk")
        .trigger(**every)
        .start()
    )
    letters_query = (
        dead_letters(checked)
        .writeStream.queryName("dead_letters")
        .foreachBatch(route_letters)
        .option("checkpointLocation", f"{checkpoint}/dead_letters")
        .trigger(**every)
        .start()
    )
    return RunningJob(risk_query, letters_query)
