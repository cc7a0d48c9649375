"""What a sink of the stored tables has done so far."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class SinkCounters:
    rows_written: int = 0
    batches_written: int = 0
    retries: int = 0
    records_skipped: int = 0
    last_batch_latency_ms: int = 0
