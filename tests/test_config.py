import pytest

from riskloom.config import load_config, parse_args


def test_defaults():
    given = load_config()
    assert given.transactions_topic == "transaction.events" and given.bootstrap_servers == "kafka:19092"
    limits = given.out_of_orderness_seconds, given.allowed_lateness_seconds, given.dedup_retention_hours
    assert limits == (30, 0, 24)
    assert given.history_max_entries == 100 and given.history_retention_ms == 60 * 60 * 1000
    assert not given.risk_settings
    db = given.database
    assert db.url.endswith("/fraud") and db.pool_size == 4
    assert (db.flush_interval_ms, db.batch_size, db.connection_timeout_ms, db.max_retry_seconds) == (200, 500, 5000, 60)


@pytest.mark.parametrize(
    "args,env,expected",
    [
        ({}, {}, "kafka:19092"),
        ({}, {"KAFKA_BOOTSTRAP_SERVERS": "broker-e:7000"}, "broker-e:7000"),
        ({"kafka.bootstrap-servers": "broker-a:7001"}, {}, "broker-a:7001"),
        ({"kafka.bootstrap-servers": "broker-a:7001"}, {"KAFKA_BOOTSTRAP_SERVERS": "broker-e:7000"}, "broker-a:7001"),
    ],
)
def test_where_a_setting_comes_from(args, env, expected):
    assert load_config(args, env).bootstrap_servers == expected


def test_numbers_are_read_from_either_place():
    given = load_config({"watermark.allowed-lateness-seconds": "45"}, {"POSTGRES_POOL_SIZE": "3", "TOPIC_RISK": "scored"})
    assert given.allowed_lateness_seconds == 45
    assert given.database.pool_size == 3 and given.risk_topic == "scored"


def test_only_rule_settings_reach_the_rules():
    args = {"risk.anomaly-multiplier": "4.5", "topic.alerts": "red"}
    env = {"RISK_ANOMALY_MULTIPLIER": "8", "RISK_ANOMALY_MIN_HISTORY": "12", "POSTGRES_URL": "jdbc:other"}
    assert load_config(args, env).risk_settings == {"risk.anomaly-multiplier": "4.5", "risk.anomaly-min-history": "12"}


@pytest.mark.parametrize("words", [["--topic.risk"], ["topic.risk", "scored"], ["--topic.risk", "scored", "--more"]])
def test_arguments_come_in_pairs(words):
    with pytest.raises(ValueError):
        parse_args(words)
    assert parse_args(["--topic.risk", "scored", "--postgres.pool-size", "3"]) == {"topic.risk": "scored", "postgres.pool-size": "3"}


def test_printing_hides_the_password():
    given = load_config({"postgres.password": "correct horse"})
    assert given.database.password == "correct horse"
    assert "horse" not in repr(given)
