"""Raw message sources: a log topic, stored raw tables and bounded lists.  All deliver ``model.RAW_SCHEMA`` columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from riskloom import model as m
from riskloom.config import EngineConfig


def topic_source_options(config: EngineConfig, *, max_offsets_per_trigger: int | None = None) -> dict[str, str]:
    """Reader options.  A query's checkpoint holds its offsets and wins; a first run starts at the earliest ones.

    Offsets committed by other consumers of the group are not used as a start; the group name serves monitoring.
    """
    options = {
        "kafka.bootstrap.servers": config.bootstrap_servers,
        "subscribe": config.transactions_topic,
        "kafka.group.id": config.consumer_group,
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
        "kafka.metadata.max.age.ms": "30000",  # new partitions are noticed within 30 s
    }
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def raw_messages(df: DataFrame) -> DataFrame:
    """The columns that parsing starts from, of whatever source delivers them."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in m.RAW_SCHEMA])


def read_topic(spark: SparkSession, config: EngineConfig, *, streaming: bool = True, **options: int) -> DataFrame:
    """Messages with their coordinates.  Needs the Kafka connector on the class path."""
    reader = spark.readStream if streaming else spark.read
    return raw_messages(reader.format("kafka").options(**topic_source_options(config, **options)).load())


def read_raw_table(spark: SparkSession, path: str, *, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """Raw messages kept as parquet files, bounded or as a stream of new files."""
    reader = (spark.readStream if streaming else spark.read).schema(m.RAW_SCHEMA)
    if streaming and max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def from_payloads(
    spark: SparkSession, payloads: Iterable[bytes | str | None], topic: str = "transaction.events", partition: int = 0
) -> DataFrame:
    """A bounded list of payloads; offsets follow the order of the list."""
    rows = [
        (None if p is None else bytearray(p.encode() if isinstance(p, str) else p), topic, partition, offset)
        for offset, p in enumerate(payloads)
    ]
    return spark.createDataFrame(rows, m.RAW_SCHEMA)
