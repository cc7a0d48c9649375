"""The stored tables in a relational database: Spark appends to staging tables, set-based inserts merge them.

The writer's partitions bound the number of connections.  The merge runs as one database transaction over the staged
batch, so a batch is stored completely or not at all, and running it again changes nothing.  A batch that the database
refuses because of single records is merged in ranges of the staged rows' ``slot`` instead, halved until the records are
found; they go to ``rejected`` with the database's reason, and everything else is stored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import DatabaseConfig
from riskloom.operators.dedup import first_per_transaction
from riskloom.operators.route import score_rows, transaction_rows
from riskloom.sinks.constraints import split_rejected
from riskloom.sinks.counters import SinkCounters
from riskloom.sinks.isolation import refuses_record, write_isolating

_TRANSACTION_COLUMNS = (
    "transaction_id, customer_id, merchant_id, amount, currency, country, event_time, status, payment_status"
)
_SCORE_COLUMNS = "transaction_id, customer_id, risk_score, risk_level, {reasons}, event_time"


def staging_tables(batch_id: int) -> dict[str, str]:
    return {name: f"staging_{name}_{batch_id}" for name in ("transactions", "risk_scores", "alert_requests")}


SLOTS = 1 << 62


def slot() -> Column:
    """A number from 0 up to SLOTS for each transaction, the same in every table."""
    return F.shiftrightunsigned(F.xxhash64("transaction_id"), 2)


def drop_statements(batch_id: int) -> list[str]:
    return [f"DROP TABLE {table}" for table in staging_tables(batch_id).values()]


def merge_statements(batch_id: int, slots: tuple[int, int] | None = None) -> list[str]:
    """Statements for one transaction: merge the staged rows, first write wins, then drop the staging tables.

    With ``slots`` only the rows from the first up to the second slot are merged, and the staging tables stay.
    """
    staged = staging_tables(batch_id)
    within = "" if slots is None else f" WHERE slot >= {slots[0]} AND slot < {slots[1]}"
    plain = _SCORE_COLUMNS.format(reasons="reasons")
    as_json = _SCORE_COLUMNS.format(reasons="CAST(reasons AS jsonb)")
    from_score = ", ".join(f"s.{column}" for column in plain.split(", "))
    return [
        f"INSERT INTO transactions ({_TRANSACTION_COLUMNS}) SELECT {_TRANSACTION_COLUMNS} "
        f"FROM {staged['transactions']}{within} ON CONFLICT (transaction_id) DO NOTHING",
        f"INSERT INTO risk_scores ({plain}) SELECT {as_json} "
        f"FROM {staged['risk_scores']}{within} ON CONFLICT (transaction_id) DO NOTHING",
        f"INSERT INTO fraud_alerts ({plain}) SELECT {from_score} FROM risk_scores s "
        f"JOIN {staged['alert_requests']} a ON a.transaction_id = s.transaction_id AND a.risk_level = s.risk_level "
        f"{within.replace('slot', 'a.slot').lstrip()}{' ' * bool(within)}ON CONFLICT (transaction_id) DO NOTHING",
        *(drop_statements(batch_id) if slots is None else []),
    ]


def jdbc_options(config: DatabaseConfig, table: str) -> dict[str, str]:
    return {
        "url": config.url,
        "user": config.user,
        "password": config.password,
        "driver": "org.postgresql.Driver",
        "dbtable": table,
        "batchsize": str(config.batch_size),
        "numPartitions": str(config.pool_size),
        "queryTimeout": "20",
        "connectTimeout": str(max(1, config.connection_timeout_ms // 1000)),
        "reWriteBatchedInserts": "true",
        "isolationLevel": "READ_COMMITTED",
    }


def run_in_one_transaction(spark: SparkSession, config: DatabaseConfig) -> Callable[[Sequence[str]], list[int]]:
    """An ``execute`` for ``DatabaseSink`` on a connection of the driver; the database's driver must be on its class path.

    It returns how many rows each statement changed.
    """

    def execute(statements: Sequence[str]) -> list[int]:
        connection = spark._jvm.java.sql.DriverManager.getConnection(config.url, config.user, config.password)
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            changed = []
            for text in statements:
                statement.execute(text)
                changed.append(max(0, statement.getUpdateCount()))
            connection.commit()
            return changed
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    return execute


@dataclass
class DatabaseSink:
    """Takes the place of the file ledger where a primary key decides about repeats, as in a continuous stream.

    ``execute`` runs a list of statements in one transaction and returns how many rows each of them changed; the first one
    tells how many transactions were new. If it returns nothing, accepted rows are counted instead. ``root`` is a shared folder for what does not go to the
    database: the written outcomes of a batch, and ``rejected``, the records that its tables would refuse.
    """

    config: DatabaseConfig
    execute: Callable[[Sequence[str]], Sequence[int] | None]
    root: str
    format: str = "jdbc"
    counters: SinkCounters = field(default_factory=SinkCounters)

    def batch_number(self, wanted: int | None) -> int:
        """Repeats are harmless here, but staging tables need a number that no other writer uses."""
        if wanted is None:
            raise ValueError("name the number of the batch")
        return wanted

    def write(self, events: DataFrame, batch_id: int) -> None:
        """Stores a batch, first write wins; ``events`` should come from a written table, as it is read once per table."""
        started = time.monotonic()
        accepted, rejected = split_rejected(events)
        first = first_per_transaction(accepted)
        now = F.current_timestamp()
        staged = {
            "transactions": transaction_rows(first, now).drop("created_at"),
            "risk_scores": score_rows(first, now).drop("created_at"),
            "alert_requests": first.where("raise_alert").select("transaction_id", "risk_level"),
        }
        aside = f"{self.root}/rejected/batch_id={batch_id}"
        rejected.write.mode("overwrite").parquet(aside)
        for name, table in staging_tables(batch_id).items():
            options = jdbc_options(self.config, table)
            staged[name].withColumn("slot", slot()).write.format(self.format).mode("overwrite").options(**options).save()
        written = self._merge(first, batch_id, aside)
        counted = events.sparkSession.read.schema(rejected.schema).parquet(aside)
        self.counters.records_skipped += counted.count()
        self.counters.rows_written += first.count() if written is None else written
        self.counters.batches_written += 1
        self.counters.last_batch_latency_ms = int((time.monotonic() - started) * 1000)

    def _merge(self, first: DataFrame, batch_id: int, aside: str) -> int | None:
        """Merges the staged rows, without those that the database refuses; how many transactions were new, if known."""
        try:
            changed = self.execute(merge_statements(batch_id))
            return None if changed is None else int(changed[0])
        except Exception as error:
            if not refuses_record(error):
                raise
        slotted = first.withColumn("slot", slot())
        new: list[int | None] = []

        def write(lo: int, hi: int) -> None:
            changed = self.execute(merge_statements(batch_id, (lo, hi)))
            new.append(None if changed is None else int(changed[0]))

        def size(lo: int, hi: int) -> int:
            return slotted.where((F.col("slot") >= lo) & (F.col("slot") < hi)).count()

        outcome = write_isolating(write, 0, SLOTS, size)
        for lo, hi, reason in outcome.refused:
            culprits = slotted.where((F.col("slot") >= lo) & (F.col("slot") < hi)).drop("slot")
            culprits.withColumn("rejection", F.lit(reason)).write.mode("append").parquet(aside)
        self.execute(drop_statements(batch_id))
        if None in new:
            return first.count() - sum(size(lo, hi) for lo, hi, _ in outcome.refused)
        return sum(new)
