"""``python -m riskloom --storage.folder /shared/risk --key value ...``: the continuous job against a log and tables.

The folder (or STORAGE_FOLDER) holds tables and stream checkpoints. It has no default: a job that starts again must find
the same one. ``--storage.sink`` (or STORAGE_SINK) is ``files``, tables in that folder with an index of their ids, or
``database``, the tables named by the ``postgres.*`` settings. With ``--log.folder`` (or LOG_FOLDER) messages come from the
log of that name in the folder, and results, alerts and dead letters go to logs there, instead of a Kafka cluster.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from riskloom.config import EngineConfig, load_config, parse_args
from riskloom.sinks.database import DatabaseSink, run_in_one_transaction
from riskloom.sinks.ledger import FileLedger
from riskloom.sinks.topics import TopicSinks
from riskloom.sources.log import raw_messages, read_topic
from riskloom.sources.segment_log import FORMAT, read_log
from riskloom.streaming.job import MetricTotals, start_stream


INDEX_BUCKETS = 256


def chosen_sink(kind: str, spark: SparkSession, config: EngineConfig, folder: str) -> FileLedger | DatabaseSink:
    if kind == "files":
        return FileLedger(spark, f"{folder}/tables", index_buckets=INDEX_BUCKETS)
    if kind == "database":
        return DatabaseSink(config.database, run_in_one_transaction(spark, config.database), f"{folder}/tables")
    raise SystemExit(f"storage.sink is files or database, not {kind}")


def main(args: list[str]) -> None:
    given = parse_args(args)
    folder = given.pop("storage.folder", None) or os.environ.get("STORAGE_FOLDER")
    logs = given.pop("log.folder", None) or os.environ.get("LOG_FOLDER")
    kind = given.pop("storage.sink", None) or os.environ.get("STORAGE_SINK", "files")
    if not folder:
        raise SystemExit("name the folder for tables and checkpoints: --storage.folder or STORAGE_FOLDER")
    config = load_config(given, os.environ)
    spark = SparkSession.builder.appName("transaction-risk").getOrCreate()
    metrics = MetricTotals()
    spark.streams.addListener(metrics)
    ledger = chosen_sink(kind, spark, config, folder)
    topic = config.transactions_topic
    messages = raw_messages(read_log(spark, f"{logs}/{topic}", streaming=True, topic=topic)) if logs else read_topic(spark, config)
    topics = TopicSinks(config, FORMAT, logs) if logs else TopicSinks(config)
    job = start_stream(messages, config, ledger, topics, f"{folder}/offsets")
    try:
        spark.streams.awaitAnyTermination()
    finally:
        job.stop()
        print("counters:", metrics.totals, ledger.counters, file=sys.stderr)


if __name__ == "__main__":
    main(sys.argv[1:])
