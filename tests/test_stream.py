"""Streaming form: order, lateness, duplicates, expiry, restart, and equality with the batch form."""

import datetime as dt
import random
import time
from decimal import Decimal

import pytest
from brute import contexts
from payloads import T0, payload
from pyspark.sql import functions as F

from riskloom.config import EngineConfig
from riskloom.sinks.ledger import FileLedger
from riskloom.sinks.topics import TopicSinks
from riskloom.sources.log import from_payloads, read_raw_table
from riskloom.streaming.job import MetricTotals, configure_for_streaming, start_stream
from riskloom.streaming.processors import CARRIED_SCHEMA
from riskloom.streaming.risk_stream import evaluated_stream, unique_stream

T0_MS = int(T0.timestamp() * 1000)
FAR = (dt.datetime(9000, 5, 4, tzinfo=dt.timezone.utc) - T0).total_seconds()  # far behind what pandas times can hold


def tx(id, seconds, customer="c1", amount="5", country="PT", status=None, offset=0):
    ms = T0_MS + round(seconds * 1000)
    when = T0.replace(tzinfo=None) + dt.timedelta(milliseconds=round(seconds * 1000))
    return (id, customer, "m", Decimal(amount), "EUR", country, when, status, ms, "t", 0, offset)


class Harness:
    """Feeds batches of rows to the evaluation and collects what it emits."""

    def __init__(self, spark, tmp_path, config=EngineConfig(), dedup_ms=None):
        configure_for_streaming(spark)
        self.spark, self.config, self.dedup_ms = spark, config, dedup_ms
        self.source, self.checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
        (tmp_path / "in").mkdir()
        self.rows, self.query = [], None

    def start(self):
        stream = self.spark.readStream.schema(CARRIED_SCHEMA).parquet(self.source)
        if self.dedup_ms is not None:
            stream = unique_stream(stream, self.dedup_ms)
        else:
            stream = evaluated_stream(stream, self.config)

        def keep(batch, batch_id):
            self.rows.extend(batch.collect())

        self.query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", self.checkpoint).start()
        return self

    def send(self, *rows):
        self.spark.createDataFrame(list(rows), CARRIED_SCHEMA).coalesce(1).write.mode("append").parquet(self.source)
        self.query.processAllAvailable()

    def advance_to(self, seconds):
        """Moves the watermark with a row of another customer; takes effect with the batch after it."""
        self.send(tx(f"clock-{seconds}", seconds + 30, customer="clock"))

    def take(self):
        taken = [r for r in self.rows if not r["transaction_id"].startswith("clock")]
        self.rows.clear()
        return taken

    def ids(self, lateness="ON_TIME"):
        return [r["transaction_id"] for r in self.take() if r["lateness"] == lateness]

    def customers_in(self, state):
        kept = self.spark.read.format("statestore").option("stateVarName", state).load(self.checkpoint)
        return sorted(r[0] for r in kept.select("key.customer_id").distinct().collect())

    def stop(self):
        self.query.stop()


@pytest.fixture
def harness(spark, tmp_path):
    started = []

    def make(**kwargs):
        started.append(Harness(spark, tmp_path, **kwargs).start())
        return started[-1]

    yield make
    for h in started:
        h.stop()


def test_order_lateness_and_expiry(harness):
    h = harness()
    h.send(tx("c", 20), tx("a", 0), tx("b", 10, country="US"), tx("tie-b", 20.5), tx("tie-a", 20.5))
    assert h.take() == []
    h.advance_to(9)
    assert h.ids() == ["a"]
    h.advance_to(10)  # the watermark reaches b exactly
    assert h.ids() == ["b"]
    h.advance_to(100)
    rows = h.take()
    assert [r["transaction_id"] for r in rows] == ["c", "tie-a", "tie-b"]
    assert rows[0]["previous_country"] == "US" and rows[0]["transactions_last_minute"] == 3
    assert rows[0]["timestamp"] == T0.replace(tzinfo=None, second=20)
    assert h.customers_in("history") == ["c1", "clock"]
    h.send(tx("late", 50), tx("exactly", 100), tx("next", 100.001))
    late = h.take()
    assert sorted(r["transaction_id"] for r in late if r["lateness"] == "LATE") == ["exactly", "late"]
    assert late[0]["transactions_last_minute"] is None
    h.advance_to(3_800)
    assert h.ids() == ["next"]
    h.send(tx("much-too-late", 1))
    assert h.ids("LATE") == ["much-too-late"]
    h.advance_to(20_000)
    h.advance_to(20_001)
    assert h.customers_in("history") == []  # everything evaluated so far has expired
    assert h.customers_in("schedule") == ["clock"]


def test_allowed_lateness(harness):
    h = harness(config=EngineConfig(allowed_lateness_seconds=60))
    h.send(tx("x", 10), tx("y", 90))
    h.advance_to(100)
    assert h.ids() == ["x", "y"]
    h.send(tx("tolerated", 70), tx("too-late", 40))
    rows = {r["transaction_id"]: r for r in h.take()}
    assert rows["too-late"]["lateness"] == "LATE"
    tolerated = rows["tolerated"]
    # evaluated at once against the entries up to its own time: x, not y
    assert (tolerated["lateness"], tolerated["recent_transaction_count"]) == ("TOLERATED", 1)
    h.send(tx("z", 129))
    h.advance_to(140)
    [z] = h.take()
    assert z["recent_transaction_count"] == 3 and z["transactions_last_minute"] == 3  # itself, y and the tolerated row


def test_restart_keeps_history_and_pending_rows(harness, spark, tmp_path):
    h = harness()
    h.send(*[tx(f"before-{i}", i, amount="1") for i in range(5)])
    h.advance_to(10)
    assert len(h.ids()) == 5
    h.send(tx("pending", 20, amount="1"))
    h.stop()
    h.start()
    h.advance_to(30)
    [row] = h.take()
    assert (row["transaction_id"], row["transactions_last_minute"]) == ("pending", 6)


def test_same_contexts_as_brute_force_in_any_arrival_order(harness):
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        rows.append(
            {
                "id": f"t{i:04d}",
                "customer": f"c{rnd.randrange(4)}",
                "ts": T0_MS + rnd.randrange(8 * 600) * 1_000,
                "amount": Decimal(rnd.randrange(1, 10**6)) / 1000,
                "country": rnd.choice(["PT", "US", None]),
                "status": rnd.choice([None, "DECLINED"]),
            }
        )
    h = harness(config=EngineConfig(out_of_orderness_seconds=6_000, history_max_entries=30))
    as_rows = [tx(r["id"], (r["ts"] - T0_MS) / 1000, r["customer"], r["amount"], r["country"], r["status"]) for r in rows]
    for part in (as_rows[:150], as_rows[150:300], as_rows[300:]):
        h.send(*part)
    h.send(tx("clock", 50_000, customer="clock"))
    got = {}
    for r in h.take():
        context = {name: r[name] for name in contexts(rows[:1])[rows[0]["id"]]}
        got[r["transaction_id"]] = context | {"known_countries": set(r["known_countries"])}
    assert got == contexts(rows, cap=30)


def wait_for(condition, seconds=90):
    until = time.time() + seconds
    while time.time() < until:
        if condition():
            return True
        time.sleep(0.5)
    return False


def test_duplicates_within_the_retention(spark, tmp_path):
    h = Harness(spark, tmp_path, dedup_ms=20_000).start()
    try:
        feed = spark.createDataFrame([tx("a", 0, offset=1), tx("a", 0, amount="9", offset=0), tx("b", 1), tx("z", FAR)], CARRIED_SCHEMA)
        feed.coalesce(1).write.mode("append").parquet(h.source)
        assert wait_for(lambda: len(h.rows) >= 3)
        first_seen = time.time()
        assert sorted((r["transaction_id"], r["amount"]) for r in h.rows) == [("a", Decimal(9)), ("b", Decimal(5)), ("z", Decimal(5))]
        assert max(r["timestamp"] for r in h.rows).year == 9000
        spark.createDataFrame([tx("a", 2), tx("c", 3)], CARRIED_SCHEMA).coalesce(1).write.mode("append").parquet(h.source)
        assert wait_for(lambda: len(h.rows) >= 4)
        assert h.rows[-1]["transaction_id"] == "c"
        time.sleep(max(0, first_seen + 22 - time.time()))
        spark.createDataFrame([tx("a", 4)], CARRIED_SCHEMA).coalesce(1).write.mode("append").parquet(h.source)
        assert wait_for(lambda: len(h.rows) >= 5)  # seen longer ago than the retention: new again
        assert h.rows[-1]["transaction_id"] == "a"
    finally:
        h.stop()


def test_the_whole_job(spark, tmp_path):
    raw = str(tmp_path / "raw")
    ledger = FileLedger(spark, str(tmp_path / "tables"))
    topics = TopicSinks(format="parquet", folder=str(tmp_path / "topics"))

    def feed(*payloads):
        from_payloads(spark, payloads).coalesce(1).write.mode("append").parquet(raw)

    feed(*[payload(f"b{i}", seconds=5 * i, amount=1000) for i in (3, 0, 5, 1, 4, 2)], "poison", payload("b0"), payload("n", amount=-1))
    metrics = MetricTotals()
    spark.streams.addListener(metrics)
    job = start_stream(
        read_raw_table(spark, raw, streaming=True),
        EngineConfig(),
        ledger,
        topics,
        str(tmp_path / "checkpoint"),
        trigger={"processingTime": "0 seconds"},
    )
    try:
        assert wait_for(lambda: job.risk.lastProgress is not None)
        feed(payload("move", "other", seconds=200))
        assert wait_for(lambda: ledger.read("transactions").count() >= 6)
        feed(payload("late", seconds=60))
        assert wait_for(lambda: ledger.read("transactions").where(F.col("status") == "LATE").count() == 1)
        assert wait_for(lambda: metrics.totals.get("late_events") == 1)
    finally:
        job.stop()
        spark.streams.removeListener(metrics)
    expected = {"transactions_rejected": 1, "messages_malformed": 1, "risk_evaluated": 6, "high_risk_alerts": 1}
    assert {name: metrics.totals[name] for name in expected} == expected
    assert metrics.duplicates_dropped == 1
    scores = {r["transaction_id"]: (r["risk_score"], r["reasons"]) for r in ledger.read("risk_scores").collect()}
    assert sorted(scores) == [f"b{i}" for i in range(6)]
    assert scores["b5"] == (80, '["HIGH_SPENDING_VELOCITY","HIGH_TRANSACTION_VELOCITY"]')
    assert [r["transaction_id"] for r in ledger.read("fraud_alerts").collect()] == ["b5"]
    letters = spark.read.parquet(f"{topics.folder}/transaction.invalid.events")
    assert letters.count() == 2
    assert len(list((tmp_path / "tables/outcomes").glob("batch_id=*"))) <= 2  # the last one, and one that was under way
