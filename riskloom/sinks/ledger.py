"""The three stored tables as parquet folders, one partition per batch.

A batch replaces its own partition when it runs again, so a replay after a failure leaves every row once.  Readers see
a batch only after all its tables are written.  Ids written by earlier batches win over later ones.

The check for stored ids reads the id column of the whole table, which suits bounded loads and short streams.  With
``index_buckets`` an index answers it (``id_index.py``): a batch then opens files in proportion to its own ids, and reads
scores on record only in the batches that hold them, however long the history is.  The rows stored are the same.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import model as m
from riskloom.sinks.constraints import split_rejected
from riskloom.sinks.counters import SinkCounters
from riskloom.sinks.first_write import new_alerts, new_rows
from riskloom.sinks.id_index import IdIndex

_BATCH = T.StructField("batch_id", T.LongType())
TABLES = {
    "transactions": m.TRANSACTIONS_TABLE,
    "risk_scores": m.RISK_SCORES_TABLE,
    "fraud_alerts": m.FRAUD_ALERTS_TABLE,
}
_COMMIT = T.StructType([T.StructField("written_rows", T.LongType()), T.StructField("skipped_rows", T.LongType())])


@dataclass
class FileLedger:
    spark: SparkSession
    root: str
    counters: SinkCounters = field(default_factory=SinkCounters)
    index_buckets: int | None = None

    def _path(self, table: str, batch_id: int | None = None) -> str:
        return f"{self.root}/{table}" if batch_id is None else f"{self.root}/{table}/batch_id={batch_id}"

    def _all(self, table: str, schema: T.StructType) -> DataFrame:
        """Every stored row with its ``batch_id``; an empty frame while the table has no files yet."""
        full = T.StructType([*schema.fields, _BATCH])
        try:
            return self.spark.read.schema(full).parquet(self._path(table))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], full)

    def _stored(self, table: str, before: int) -> DataFrame:
        return self._with_batch(table, before).drop("batch_id")

    def _with_batch(self, table: str, before: int) -> DataFrame:
        return self._all(table, TABLES[table]).where(F.col("batch_id") < before)

    def _index(self, table: str) -> IdIndex:
        return IdIndex(self.spark, f"{self.root}/ids/{table}", self.index_buckets)

    def _indexed(self, table: str, before: int) -> IdIndex:
        """The index of a table; earlier batches that were written without one get it now."""
        index = self._index(table)
        if not index.units():
            rows = self._with_batch(table, before).select("transaction_id", F.col("batch_id").alias("batch"))
            last = rows.agg(F.max("batch")).first()[0]
            if last is not None:
                index.load(rows, last)
        return index

    def _known(self, table: str, ids: DataFrame, before: int, asked: Callable[[], DataFrame] | None = None) -> DataFrame:
        """A frame with at least the given ids that earlier batches have stored."""
        if self.index_buckets is None:
            return self._stored(table, before)
        return self._indexed(table, before).known(ids, before, asked)

    def _on_record(self, table: str, ids: DataFrame, before: int) -> DataFrame:
        """Rows of earlier batches, at least those with the given ids."""
        if self.index_buckets is None:
            return self._stored(table, before)
        known = self._indexed(table, before).known(ids, before)
        batches = [r["batch"] for r in known.select("batch").distinct().collect()]  # no more than ids
        return self._with_batch(table, before).where(F.col("batch_id").isin(batches)).drop("batch_id")  # prunes folders

    def batch_number(self, wanted: int | None) -> int:
        """The next number if none is wanted. A number before the last one stored is refused."""
        last = self.last_batch()
        if wanted is None:
            return 0 if last is None else last + 1
        if last is not None and wanted < last:
            raise ValueError(f"batch {wanted} is older than the last one stored, {last}")
        return wanted

    def last_batch(self) -> int | None:
        return self._all("commits", _COMMIT).agg(F.max("batch_id")).first()[0]

    def read(self, table: str) -> DataFrame:
        """Rows of completely written batches."""
        last = self.last_batch()
        return self._stored(table, 0 if last is None else last + 1)

    def rejected(self) -> DataFrame:
        last = self.last_batch()
        schema = T.StructType([*_EVENT_FIELDS, T.StructField("rejection", T.StringType())])
        return self._all("rejected", schema).where(F.col("batch_id") <= F.lit(-1 if last is None else last))

    def write(self, events: DataFrame, batch_id: int) -> None:
        """Stores persistable events: first write wins, records that break a constraint are set aside and counted.

        ``events`` should come from a written table: it is read once per stored table.
        """
        started = time.monotonic()
        now = F.lit(self.spark.sql("SELECT current_timestamp()").first()[0])
        accepted, rejected = split_rejected(events)
        asked = cache(lambda: self._index("transactions").asked(accepted))  # both tables are asked for the same ids
        transactions, scores = new_rows(
            accepted,
            self._known("transactions", accepted, batch_id, asked),
            self._known("risk_scores", accepted, batch_id, asked),
            now,
        )
        self._replace(rejected, "rejected", batch_id)
        self._replace(transactions, "transactions", batch_id)
        self._replace(scores, "risk_scores", batch_id)
        raised = accepted.where("raise_alert")
        this_batch = self.spark.read.schema(TABLES["risk_scores"]).parquet(self._path("risk_scores", batch_id))
        on_record = self._on_record("risk_scores", raised, batch_id).unionByName(this_batch)
        alerts = new_alerts(accepted, on_record, self._known("fraud_alerts", raised, batch_id), now)
        self._replace(alerts, "fraud_alerts", batch_id)
        if self.index_buckets is not None:
            for table in TABLES:
                written_ids = self.spark.read.schema(TABLES[table]).parquet(self._path(table, batch_id))
                self._index(table).add(written_ids, batch_id)
        skipped = self._rows_in("rejected", batch_id)
        written = self._rows_in("transactions", batch_id)
        commit = self.spark.createDataFrame([(written, skipped)], _COMMIT).coalesce(1)
        self._replace(commit, "commits", batch_id)
        self.counters.rows_written += written
        self.counters.records_skipped += skipped
        self.counters.batches_written += 1
        self.counters.last_batch_latency_ms = int((time.monotonic() - started) * 1000)

    def _replace(self, rows: DataFrame, table: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(self._path(table, batch_id))

    def _rows_in(self, table: str, batch_id: int) -> int:
        return self.spark.read.parquet(self._path(table, batch_id)).count()


_EVENT_FIELDS = [
    *m.TRANSACTION_FIELDS,
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("risk_score", T.IntegerType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("reasons", T.ArrayType(T.StringType())),
    T.StructField("raise_alert", T.BooleanType()),
]
EVENT_SCHEMA = T.StructType(_EVENT_FIELDS)
