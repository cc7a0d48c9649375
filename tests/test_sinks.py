import json
from decimal import Decimal
from itertools import islice

import pytest
from payloads import T0, payload
from pyspark.sql import functions as F

from riskloom.config import DatabaseConfig, EngineConfig
from riskloom.operators.route import alert_records, dead_letter_records, risk_result_records
from riskloom.sinks.database import DatabaseSink, jdbc_options, merge_statements
from riskloom.sinks.ledger import EVENT_SCHEMA, FileLedger
from riskloom.sinks.retry import GivingUp, RetryPolicy, with_retries
from riskloom.sinks.topics import TopicSinks
from riskloom.sources.log import from_payloads, read_raw_table, topic_source_options
from riskloom.streaming.job import run_batch

NAIVE_T0 = T0.replace(tzinfo=None)


def event(id, score=None, *, status="PROCESSED", offset=0, **changes):
    level = None if score is None else "LOW" if score < 40 else "MEDIUM" if score < 70 else "HIGH"
    row = {
        "transaction_id": id,
        "customer_id": "c",
        "merchant_id": "m",
        "amount": Decimal("12.34567"),
        "currency": "EUR",
        "country": "PT",
        "timestamp": NAIVE_T0,
        "payment_status": None,
        "topic": "t",
        "partition": 0,
        "offset": offset,
        "status": status,
        "risk_score": score,
        "risk_level": level,
        "reasons": None if score is None else ["A", "B"],
        "raise_alert": level == "HIGH",
    } | changes
    return tuple(row[f.name] for f in EVENT_SCHEMA)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT_SCHEMA)


@pytest.fixture(params=[None, 3], ids=["ids read", "ids indexed"])
def ledger(spark, tmp_path, request):
    return FileLedger(spark, str(tmp_path / "tables"), index_buckets=request.param)


def counts(ledger):
    return [ledger.read(t).count() for t in ("transactions", "risk_scores", "fraud_alerts")]


def test_empty_ledger(ledger):
    assert counts(ledger) == [0, 0, 0]


def test_rows_and_columns(spark, ledger):
    ledger.write(events(spark, event("t1", 80), event("d", 10, payment_status="DECLINED"), event("l", status="LATE")), 0)
    rows = {r["transaction_id"]: r for r in ledger.read("transactions").collect()}
    assert rows["t1"]["amount"] == Decimal("12.3457") and rows["t1"]["event_time"] == NAIVE_T0
    assert (rows["t1"]["payment_status"], rows["d"]["payment_status"]) == ("APPROVED", "DECLINED")
    assert rows["l"]["status"] == "LATE" and rows["l"]["created_at"] is not None
    [alert] = ledger.read("fraud_alerts").collect()
    assert (alert["transaction_id"], alert["risk_score"], alert["reasons"]) == ("t1", 80, '["A","B"]')
    assert counts(ledger) == [3, 2, 1]


def test_replays_and_repeats_leave_one_row(spark, ledger):
    batch = events(spark, event("t1", 80, offset=1), event("t1", 10, offset=2), event("t2", 10))
    ledger.write(batch, 0)
    ledger.write(batch, 0)  # the same batch again, as after a failure
    ledger.write(batch, 1)  # the same events in a later batch
    assert counts(ledger) == [2, 2, 1]
    assert ledger.last_batch() == 1


def test_first_write_wins_and_alerts_agree_with_it(spark, ledger):
    ledger.write(events(spark, event("t1", 10)), 0)
    ledger.write(events(spark, event("t1", 90), event("t2", 90)), 1)
    ledger.write(events(spark, event("t2", 95)), 2)
    assert {r["transaction_id"]: r["risk_score"] for r in ledger.read("risk_scores").collect()} == {"t1": 10, "t2": 90}
    assert [(r["transaction_id"], r["risk_score"]) for r in ledger.read("fraud_alerts").collect()] == [("t2", 90)]


def test_only_bad_records_are_set_aside(spark, ledger):
    bad = [
        event("country", 10, country="PRT"),
        event("currency", 10, currency="EURO"),
        event("merchant", 10, merchant_id=None),
        event("x" * 101, 10),
        event("amount", 10, amount=Decimal("999999999999999.99995")),
        event("nul", 10, customer_id="a\x00b"),
    ]
    fine = [event("a", 10), event("blank", 10, country="PT  "), event("big", 10, amount=Decimal("999999999999999.9999"))]
    ledger.write(events(spark, *bad, *fine), 0)
    assert sorted(r["transaction_id"] for r in ledger.read("transactions").collect()) == ["a", "big", "blank"]
    reasons = {r["transaction_id"]: r["rejection"] for r in ledger.rejected().collect()}
    assert len(reasons) == 6 and reasons["merchant"] == "merchant_id must not be null"
    assert (ledger.counters.rows_written, ledger.counters.records_skipped, ledger.counters.batches_written) == (3, 6, 1)


def test_an_unfinished_batch_is_not_visible(spark, ledger, monkeypatch):
    ledger.write(events(spark, event("t1", 10)), 0)
    replace = FileLedger._replace

    def failing(self, rows, table, batch_id):
        if table == "fraud_alerts":
            raise OSError("disk gone")
        replace(self, rows, table, batch_id)

    monkeypatch.setattr(FileLedger, "_replace", failing)
    with pytest.raises(OSError):
        ledger.write(events(spark, event("t2", 90)), 1)
    assert counts(ledger) == [1, 1, 0]
    monkeypatch.setattr(FileLedger, "_replace", replace)
    ledger.write(events(spark, event("t2", 90)), 1)
    assert counts(ledger) == [2, 2, 1]


class Clock:
    def __init__(self):
        self.now, self.sleeps = 0.0, []

    def sleep(self, seconds):
        self.sleeps.append(seconds)
        self.now += seconds


def retried(write, policy, clock, **kwargs):
    return with_retries(write, policy, sleep=clock.sleep, clock=lambda: clock.now, **kwargs)


def test_pauses_grow_and_then_stay():
    policy = RetryPolicy(initial_s=0.5, max_s=3, multiplier=3)
    assert list(islice(policy.pauses(), 5)) == [0.5, 1.5, 3, 3, 3]
    assert next(RetryPolicy().pauses()) == 0.2 and list(islice(RetryPolicy().pauses(), 40))[-1] == 5.0


@pytest.mark.parametrize("failures", [0, 1, 5])
def test_a_write_that_recovers(failures):
    clock, outcomes, seen = Clock(), ["down"] * failures + ["up"], []

    def write():
        if (state := outcomes.pop(0)) == "down":
            raise OSError(state)
        return state

    assert retried(write, RetryPolicy(max_elapsed_s=90, initial_s=2, max_s=7), clock, on_retry=seen.append) == "up"
    assert len(seen) == len(clock.sleeps) == failures and not outcomes
    assert clock.sleeps == sorted(clock.sleeps) and all(2 <= s <= 7 for s in clock.sleeps)


def test_a_write_that_never_recovers():
    clock, tries = Clock(), []

    def write():
        tries.append(clock.now)
        raise OSError("unreachable")

    with pytest.raises(GivingUp, match="unreachable"):
        retried(write, RetryPolicy(max_elapsed_s=20, initial_s=3, max_s=6), clock)
    assert tries[-2] < 20 <= tries[-1] and len(tries) == len(clock.sleeps) + 1
    tries.clear()
    with pytest.raises(OSError):
        retried(write, RetryPolicy(), clock, retryable=lambda e: not isinstance(e, OSError))
    assert len(tries) == 1


def test_json_shapes(spark):
    scored = events(spark, event("p9", 91, customer_id="kiosk"))
    row = risk_result_records(scored).first()
    assert bytes(row["key"]) == b"kiosk"
    assert json.loads(bytes(row["value"])) == {
        "transactionId": "p9",
        "customerId": "kiosk",
        "riskScore": 91,
        "riskLevel": "HIGH",
        "reasons": ["A", "B"],
        "timestamp": "2027-03-02T08:00:00Z",
    }
    from riskloom.operators.score import high_risk_alerts

    row = alert_records(high_risk_alerts(scored)).first()
    assert json.loads(bytes(row["value"]))["alertId"] == "high-risk-v1-p9"
    assert json.loads(bytes(row["value"]))["transactionTimestamp"] == "2027-03-02T08:00:00Z"
    letter = spark.createDataFrame(
        [("DESERIALIZATION", "MALFORMED_PAYLOAD", "bad", None, 'gar"bage', "t", 1, 7, NAIVE_T0)],
        "source string, code string, detail string, transaction_id string, payload string, topic string, "
        "partition int, offset long, detected_at timestamp",
    )
    row = dead_letter_records(letter).first()
    document = json.loads(bytes(row["value"]))
    assert row["key"] is None and document["transactionId"] is None and document["payload"] == 'gar"bage'
    assert list(document) == [
        "source", "code", "detail", "transactionId", "payload", "topic", "partition", "offset", "detectedAt",
    ]


@pytest.mark.parametrize(
    "micros,text", [(0, "08:00:00Z"), (250_000, "08:00:00.250Z"), (250_001, "08:00:00.250001Z")]
)
def test_instants_are_printed_as_needed(spark, micros, text):
    from riskloom.functions.instants import format_instant

    when = F.timestamp_micros(F.lit(1_803_974_400_000_000 + micros))
    assert spark.range(1).select(format_instant(when)).first()[0] == f"2027-03-02T{text}"
    assert spark.range(1).select(format_instant(F.timestamp_micros(F.lit(-1)))).first()[0] == "1969-12-31T23:59:59.999999Z"


def test_topic_options():
    config = EngineConfig(bootstrap_servers="broker:7000")
    source = topic_source_options(config, max_offsets_per_trigger=10)
    assert source["subscribe"] == "transaction.events" and source["startingOffsets"] == "earliest"
    assert source["kafka.bootstrap.servers"] == "broker:7000" and source["maxOffsetsPerTrigger"] == "10"
    assert TopicSinks(config).options("letters", 3)["topic"] == "letters"
    assert TopicSinks(config, "json", "/out").options("letters", 3) == {"path": "/out/letters/batch_id=3"}


def test_database_statements():
    statements = merge_statements(7)
    assert len(statements) == 6
    assert all("ON CONFLICT (transaction_id) DO NOTHING" in s for s in statements[:3])
    assert "JOIN staging_alert_requests_7 a" in statements[2] and "s.risk_level" in statements[2]
    options = jdbc_options(DatabaseConfig(), "t")
    assert (options["batchsize"], options["numPartitions"]) == ("500", "4")


def test_batch_job_into_a_database(spark, tmp_path, monkeypatch):
    """The statements go to a stub; staging tables are folders."""
    import riskloom.sinks.database as database

    staged = tmp_path / "staged"
    monkeypatch.setattr(database, "jdbc_options", lambda config, table: {"path": str(staged / table)})
    executed, failures = [], [1]

    def execute(given):
        if failures[0]:
            failures[0] -= 1
            raise ConnectionError("down")
        executed.append(list(given))

    sink = DatabaseSink(DatabaseConfig(), execute, str(tmp_path / "aside"), format="parquet")
    given = [payload(f"d{i}", seconds=5 * i, amount=1000) for i in range(6)] + [payload("odd", "c2", country="PRT"), payload("d0", amount=5)]
    path = str(tmp_path / "raw")
    from_payloads(spark, given).write.parquet(path)
    topics = TopicSinks(format="parquet", folder=str(tmp_path / "topics"))
    with pytest.raises(ValueError, match="number"):
        run_batch(read_raw_table(spark, path), EngineConfig(), sink, topics)
    run_batch(read_raw_table(spark, path), EngineConfig(), sink, topics, batch_id=7)
    assert executed == [merge_statements(7)]
    assert [r["transaction_id"] for r in spark.read.parquet(f"{sink.root}/rejected").collect()] == ["odd"]
    assert spark.read.parquet(str(staged / "staging_risk_scores_7")).count() == 6
    assert [r["transaction_id"] for r in spark.read.parquet(str(staged / "staging_alert_requests_7")).collect()] == ["d5"]
    c = sink.counters
    assert (c.retries, c.batches_written, c.rows_written, c.records_skipped) == (1, 1, 6, 1)


def test_batch_job_end_to_end(spark, ledger, tmp_path):
    given = [payload(f"b{i}", seconds=5 * i, amount=1000) for i in range(6)] + ["poison", payload("b0", amount=5)]
    raw_path = str(tmp_path / "raw")
    from_payloads(spark, given).write.parquet(raw_path)
    topics = TopicSinks(format="parquet", folder=str(tmp_path / "topics"))
    for _ in range(2):  # the second run repeats the first
        run_batch(read_raw_table(spark, raw_path), EngineConfig(), ledger, topics, batch_id=0)
    assert counts(ledger) == [6, 6, 1]
    assert spark.read.parquet(f"{topics.folder}/fraud.high-risk.alerts").count() == 1
    assert spark.read.parquet(f"{topics.folder}/{topics.config.risk_topic}").count() == 6
    assert spark.read.parquet(f"{topics.folder}/transaction.invalid.events").count() == 1


def test_a_second_load_keeps_the_first(spark, ledger, tmp_path):
    topics = TopicSinks(format="parquet", folder=str(tmp_path / "topics"))
    for number, ids in enumerate((["k1", "k2"], ["k2", "k3"])):
        path = str(tmp_path / f"raw{number}")
        from_payloads(spark, [payload(i, customer=i) for i in ids]).write.parquet(path)
        run_batch(read_raw_table(spark, path), EngineConfig(), ledger, topics)
    assert {r["transaction_id"] for r in ledger.read("transactions").collect()} == {"k1", "k2", "k3"}
    assert ledger.last_batch() == 1
    with pytest.raises(ValueError, match="older"):
        run_batch(read_raw_table(spark, path), EngineConfig(), ledger, topics, batch_id=0)


class RefusingDatabase:
    """Runs the merges over the staged folders: first write wins, records of one country are refused with a constraint error."""

    def __init__(self, spark, staged, refused):
        self.spark, self.staged, self.refused, self.stored, self.calls = spark, staged, refused, {}, 0

    def __call__(self, statements):
        import re

        self.calls += 1
        if statements[0].startswith("DROP"):
            return [0] * len(statements)
        table = re.search(r"FROM (staging_transactions_\d+)", statements[0])[1]
        bounds = re.search(r"slot >= (\d+) AND slot < (\d+)", statements[0])
        rows = self.spark.read.parquet(str(self.staged / table))
        if bounds:
            rows = rows.where(f"slot >= {bounds[1]} and slot < {bounds[2]}")
        rows = {r["transaction_id"]: r for r in rows.collect()}
        if self.refused & rows.keys():
            error = RuntimeError("violates a check")
            error.sqlstate = "23514"
            raise error
        new = rows.keys() - self.stored.keys()
        self.stored |= {i: rows[i] for i in new}
        return [len(new), 0, 0, *[0] * (len(statements) - 3)]


def test_database_refuses_single_records(spark, tmp_path, monkeypatch):
    import riskloom.sinks.database as database

    staged = tmp_path / "staged"
    monkeypatch.setattr(database, "jdbc_options", lambda config, table: {"path": str(staged / table)})
    store = RefusingDatabase(spark, staged, {"d3", "d11"})
    sink = DatabaseSink(DatabaseConfig(), store, str(tmp_path / "aside"), format="parquet")
    topics = TopicSinks(format="parquet", folder=str(tmp_path / "topics"))
    path = str(tmp_path / "raw")
    from_payloads(spark, [payload(f"d{i}", customer=f"c{i}") for i in range(16)]).write.parquet(path)
    run_batch(read_raw_table(spark, path), EngineConfig(), sink, topics, batch_id=1)
    assert sorted(store.stored) == sorted(f"d{i}" for i in range(16) if i not in (3, 11))
    rejected = spark.read.parquet(f"{sink.root}/rejected").collect()
    assert {(r["transaction_id"], r["rejection"]) for r in rejected} == {("d3", "violates a check"), ("d11", "violates a check")}
    assert (sink.counters.rows_written, sink.counters.records_skipped) == (14, 2)
    run_batch(read_raw_table(spark, path), EngineConfig(), sink, topics, batch_id=2)  # a replay under another number
    assert sink.counters.rows_written == 14 and len(store.stored) == 14  # counts what the merge inserted


def test_ranged_merge_statements():
    ranged = merge_statements(7, (5, 9))
    assert len(ranged) == 3 and "WHERE slot >= 5 AND slot < 9 ON CONFLICT" in ranged[0]
    assert "WHERE a.slot >= 5 AND a.slot < 9 ON CONFLICT" in ranged[2]
    assert "WHERE" not in "".join(merge_statements(7)[:2])


def test_a_ledger_gets_its_index_later(spark, tmp_path):
    topics = TopicSinks(format="parquet", folder=str(tmp_path / "topics"))
    plain = FileLedger(spark, str(tmp_path / "tables"))
    indexed = FileLedger(spark, str(tmp_path / "tables"), index_buckets=3)
    for number, (ledger, ids) in enumerate([(plain, ["k1", "k2"]), (indexed, ["k2", "k3"]), (indexed, ["k1", "k3", "k4"])]):
        path = str(tmp_path / f"raw{number}")
        from_payloads(spark, [payload(i, customer=i) for i in ids]).write.parquet(path)
        run_batch(read_raw_table(spark, path), EngineConfig(), ledger, topics)
    assert sorted(r["transaction_id"] for r in indexed.read("transactions").collect()) == ["k1", "k2", "k3", "k4"]
    assert indexed.counters.rows_written == 2


def test_the_sink_is_chosen(spark, tmp_path):
    from riskloom.__main__ import chosen_sink

    assert isinstance(chosen_sink("files", spark, EngineConfig(), str(tmp_path)), FileLedger)
    assert isinstance(chosen_sink("database", spark, EngineConfig(), str(tmp_path)), DatabaseSink)
    with pytest.raises(SystemExit):
        chosen_sink("paper", spark, EngineConfig(), str(tmp_path))
