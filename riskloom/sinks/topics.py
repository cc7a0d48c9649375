"""Log sinks: JSON records to three topics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from riskloom.config import EngineConfig
from riskloom.operators.route import alert_records, dead_letter_records, risk_result_records
from riskloom.sources.segment_log import FORMAT, register


@dataclass(frozen=True)
class TopicSinks:
    """Writes ``key, value`` records.

    ``segment_log`` writes a log for each topic below ``folder`` (``riskloom/sources/segment_log.py``), exactly once: a
    repeated batch finds itself committed, and readers see whole batches only.  ``kafka`` is at-least-once with Spark's
    writer; results are keyed by customer and alerts carry an id that depends on the transaction alone, so consumers drop
    repeats by ``transactionId`` and ``alertId``.  Another format writes files, a folder for each topic and
    batch in it, which a repeated batch replaces.
    """

    config: EngineConfig = field(default_factory=EngineConfig)
    format: str = "kafka"
    folder: str | None = None

    def options(self, topic: str, batch_id: int) -> dict[str, str]:
        if self.format == FORMAT:
            return {"path": f"{self.folder}/{topic}", "writer": "job", "batch": str(batch_id)}
        if self.format != "kafka":
            return {"path": f"{self.folder}/{topic}/batch_id={batch_id}"}
        return {
            "kafka.bootstrap.servers": self.config.bootstrap_servers,
            "topic": topic,
            "kafka.acks": "all",
            "kafka.enable.idempotence": "true",
            "kafka.delivery.timeout.ms": str(self.config.transaction_timeout_ms),
        }

    def _write(self, records: DataFrame, topic: str, batch_id: int) -> None:
        if self.format == FORMAT:
            register(records.sparkSession)
            records = records.select("key", "value")
        mode = "append" if self.format in ("kafka", FORMAT) else "overwrite"
        records.write.format(self.format).mode(mode).options(**self.options(topic, batch_id)).save()

    def write_results(self, scored: DataFrame, batch_id: int) -> None:
        self._write(risk_result_records(scored), self.config.risk_topic, batch_id)

    def write_alerts(self, alerts: DataFrame, batch_id: int) -> None:
        self._write(alert_records(alerts), self.config.alerts_topic, batch_id)

    def write_dead_letters(self, letters: DataFrame, batch_id: int) -> None:
        self._write(dead_letter_records(letters), self.config.invalid_topic, batch_id)
