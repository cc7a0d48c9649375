"""Settings: a program argument wins over an environment variable, which wins over the default."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields

from riskloom import model as m


# The defaults in both classes.
@dataclass(frozen=True, repr=False)
class DatabaseConfig:
    url: str = "jdbc:postgresql://postgres:5432/fraud"
    user: str = "fraud"
    password: str = "fraud"
    pool_size: int = 4
    connection_timeout_ms: int = 5_000
    batch_size: int = 500
    flush_interval_ms: int = 200
    max_retry_seconds: int = 60

    def __repr__(self) -> str:
        shown = {f.name: "***" if f.name == "password" else getattr(self, f.name) for f in fields(self)}
        return f"DatabaseConfig({', '.join(f'{name}={value}' for name, value in shown.items())})"


@dataclass(frozen=True)
class EngineConfig:
    bootstrap_servers: str = "kafka:19092"
    transactions_topic: str = "transaction.events"
    risk_topic: str = "transaction.risk.events"
    invalid_topic: str = "transaction.invalid.events"
    alerts_topic: str = "fraud.high-risk.alerts"
    consumer_group: str = "fraud-risk-job"
    transactional_id_prefix: str = "fraud-risk"
    alerts_transactional_id_prefix: str = "fraud-alerts"
    transaction_timeout_ms: int = 600_000
    out_of_orderness_seconds: int = 30
    idleness_seconds: int = 30
    allowed_lateness_seconds: int = 0
    dedup_retention_hours: int = 24
    history_retention_ms: int = m.HISTORY_RETENTION_MS
    history_max_entries: int = m.HISTORY_MAX_ENTRIES
    risk_settings: Mapping[str, str] = field(default_factory=dict)
    database: DatabaseConfig = field(default_factory=DatabaseConfig)


# Setting keys and the field each one fills.
_ENGINE_KEYS = {
    "kafka.bootstrap-servers": "bootstrap_servers",
    "topic.transactions": "transactions_topic",
    "topic.risk": "risk_topic",
    "topic.invalid": "invalid_topic",
    "topic.alerts": "alerts_topic",
    "kafka.consumer-group": "consumer_group",
    "kafka.transactional-id-prefix": "transactional_id_prefix",
    "kafka.alerts-transactional-id-prefix": "alerts_transactional_id_prefix",
    "kafka.transaction-timeout-ms": "transaction_timeout_ms",
    "watermark.out-of-orderness-seconds": "out_of_orderness_seconds",
    "watermark.idleness-seconds": "idleness_seconds",
    "watermark.allowed-lateness-seconds": "allowed_lateness_seconds",
    "dedup.retention-hours": "dedup_retention_hours",
}
_DATABASE_KEYS = {
    "postgres.url": "url",
    "postgres.user": "user",
    "postgres.password": "password",
    "postgres.pool-size": "pool_size",
    "postgres.connection-timeout-ms": "connection_timeout_ms",
    "postgres.batch-size": "batch_size",
    "postgres.flush-interval-ms": "flush_interval_ms",
    "postgres.max-retry-seconds": "max_retry_seconds",
}


def parse_args(args: Sequence[str]) -> dict[str, str]:
    """``--key value`` pairs; a key without a value is an error, so typos are not silently ignored."""
    if len(args) % 2 or any(not key.startswith("--") for key in args[::2]):
        raise ValueError(f"expected '--key value' pairs, got: {' '.join(args)}")
    return {key[2:]: value for key, value in zip(args[::2], args[1::2])}


def risk_settings(args: Mapping[str, str], env: Mapping[str, str]) -> dict[str, str]:
    """Every ``risk.*`` setting; ``RISK_A_B`` in the environment means ``risk.a-b``."""
    from_env = {
        "risk." + name.removeprefix("RISK_").lower().replace("_", "-"): value
        for name, value in env.items()
        if name.startswith("RISK_")
    }
    return from_env | {key: value for key, value in args.items() if key.startswith("risk.")}


def _collect(target, keys: Mapping[str, str], args: Mapping[str, str], env: Mapping[str, str]) -> dict:
    values = {}
    for key, name in keys.items():
        given = args.get(key, env.get(key.upper().replace(".", "_").replace("-", "_")))
        if given is not None:
            values[name] = type(getattr(target, name))(given)
    return values


def load_config(args: Mapping[str, str] | None = None, env: Mapping[str, str] | None = None) -> EngineConfig:
    args, env = args or {}, env or {}
    database = DatabaseConfig(**_collect(DatabaseConfig, _DATABASE_KEYS, args, env))
    return EngineConfig(
        **_collect(EngineConfig, _ENGINE_KEYS, args, env),
        risk_settings=risk_settings(args, env),
        database=database,
    )
