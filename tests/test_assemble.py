"""The bounded dataflow over whole scenarios."""

import pytest
from payloads import payload

from riskloom.config import EngineConfig
from riskloom.operators.slices import SkewLimits
from riskloom.plans.assemble import assemble
from riskloom.sources.log import from_payloads


def run(spark, payloads, **kwargs):
    streams = assemble(from_payloads(spark, payloads), **kwargs)
    lines = [f"RISK {r['transaction_id']} {r['risk_level']} {r['reasons']}" for r in streams.outcomes.collect()]
    lines += [f"INVALID {r['source']} {r['code']} {r['transaction_id']}" for r in streams.invalid.collect()]
    lines += [f"LATE {r['transaction_id']}" for r in streams.late.collect()]
    lines += [
        f"PERSIST {r['transaction_id']} {r['status']} {r['raise_alert']}" for r in streams.persistable.collect()
    ]
    lines += [f"ALERT {r['alert_id']} {r['risk_score']} {r['reasons']}" for r in streams.alerts.collect()]
    return sorted(lines)


def risk_lines(spark, payloads, **kwargs):
    return [line for line in run(spark, payloads, **kwargs) if line.startswith("RISK")]


def burst(prefix, amount, n=6, **kwargs):
    return [payload(f"{prefix}{i}", seconds=5 * (i - 1), amount=amount, **kwargs) for i in range(1, n + 1)]


def test_normal_and_duplicate(spark):
    expected = ["PERSIST t1 PROCESSED False", "RISK t1 LOW []"]
    assert run(spark, [payload("t1")]) == expected
    assert run(spark, [payload("t1"), payload("t1"), payload("t1", amount=9_999)]) == expected


def test_invalid_messages_do_not_stop_the_rest(spark):
    given = ["poison", payload("bad", amount="-5"), payload("ok", seconds=1), '{"transactionId":"no-customer"}']
    lines = run(spark, given)
    assert len(lines) == 5
    assert "INVALID DESERIALIZATION MALFORMED_PAYLOAD None" in lines
    assert "INVALID VALIDATION AMOUNT_NOT_POSITIVE bad" in lines
    assert any("PIPELINE_CUSTOMER_ID_MISSING" in line and line.endswith("no-customer") for line in lines)
    assert "RISK ok LOW []" in lines and "PERSIST ok PROCESSED False" in lines


def test_velocity_and_spending(spark):
    lines = risk_lines(spark, burst("v", 1)[::-1])
    assert lines[-1] == "RISK v6 MEDIUM ['HIGH_TRANSACTION_VELOCITY']"
    assert sum("[]" in line for line in lines) == 5
    spending = [payload(f"s{i}", seconds=20 * i, amount=2000) for i in range(3)]
    assert risk_lines(spark, spending)[2] == "RISK s2 MEDIUM ['HIGH_SPENDING_VELOCITY']"


def test_high_risk_burst_raises_one_alert(spark):
    lines = run(spark, burst("b", 1000) + [payload("calm", customer="c2")])
    alerts = [line for line in lines if line.startswith("ALERT")]
    assert alerts == ["ALERT high-risk-v1-b6 80 ['HIGH_SPENDING_VELOCITY', 'HIGH_TRANSACTION_VELOCITY']"]
    assert "PERSIST b6 PROCESSED True" in lines
    assert sum(line.startswith("RISK") for line in lines) == 7


def test_countries(spark):
    trip = [payload("a", seconds=0), payload("b", seconds=60, country="US"), payload("c", seconds=120)]
    expected = [
        "RISK a LOW []",
        "RISK b MEDIUM ['GEOGRAPHIC_IMPOSSIBILITY']",
        "RISK c MEDIUM ['GEOGRAPHIC_IMPOSSIBILITY']",
    ]
    assert risk_lines(spark, trip) == expected
    assert risk_lines(spark, trip[::-1]) == expected  # arrival order does not matter
    far = [payload("pt", seconds=0), payload("us", seconds=180, country="US")]
    assert risk_lines(spark, far)[1] == "RISK us MEDIUM ['GEOGRAPHIC_IMPOSSIBILITY']"
    config = EngineConfig(risk_settings={"risk.impossible-travel-minutes": "2"})
    assert risk_lines(spark, far, config=config)[1] == "RISK us LOW []"


def test_unusual_amount_and_new_country(spark):
    usual = [payload(f"a{i}", seconds=10 * i, amount=a) for i, a in enumerate((25, 30, 20, 900))]
    assert risk_lines(spark, usual)[3] == "RISK a3 LOW ['UNUSUAL_AMOUNT']"
    new = [payload(f"n{i}", seconds=60 * i, amount=20) for i in range(3)]
    new.append(payload("n3", seconds=1200, amount=100, country="US"))
    assert risk_lines(spark, new)[3] == "RISK n3 MEDIUM ['NEW_COUNTRY_HIGH_AMOUNT']"


def test_declined_attempts(spark):
    declined = [payload(f"d{i}", seconds=5 * i, amount=10, status="DECLINED") for i in range(3)]
    lines = risk_lines(spark, [*declined, payload("ok", seconds=20, amount=10)])
    assert lines == [*[f"RISK d{i} LOW []" for i in range(3)], "RISK ok MEDIUM ['FAILED_ATTEMPTS_THEN_SUCCESS']"]
    many = [payload(f"x{i}", seconds=5 * i, amount=9000, status="DECLINED") for i in range(5)]
    lines = risk_lines(spark, [*many, payload("ok", seconds=25, amount=10)])
    assert lines[0] == "RISK ok HIGH ['FAILED_ATTEMPTS_THEN_SUCCESS', 'HIGH_TRANSACTION_VELOCITY']"
    assert not any("SPENDING" in line for line in lines)


def test_unknown_status_is_malformed(spark):
    assert run(spark, [payload("x", status="MAYBE")]) == ["INVALID DESERIALIZATION MALFORMED_PAYLOAD None"]


@pytest.mark.parametrize("stage", [True, False])
def test_late_arrivals(spark, stage):
    from pyspark.sql import functions as F

    given = [payload("a", seconds=0), payload("b", seconds=100), payload("late", seconds=70), payload("in", seconds=71)]
    raw = from_payloads(spark, given).withColumn("arrived", F.when(F.col("offset") < 2, 1).otherwise(2))
    streams = assemble(raw, arrival_batch="arrived", stage=stage)
    assert [r["transaction_id"] for r in streams.late.collect()] == ["late"]
    assert sorted(r["transaction_id"] for r in streams.outcomes.collect()) == ["a", "b", "in"]
    rows = {r["transaction_id"]: r for r in streams.persistable.collect()}
    assert (rows["late"]["status"], rows["late"]["risk_score"], rows["late"]["raise_alert"]) == ("LATE", None, False)
    assert rows["in"]["status"] == "PROCESSED"


def test_hot_customer_gives_the_same_results(spark):
    given = [payload(f"h{i:03d}", "hot", seconds=i, amount=1 + i) for i in range(260)] + burst("b", 1000)
    limits = SkewLimits(rows_per_slice=110)
    assert run(spark, given, limits=limits) == run(spark, given)


def test_rows_without_a_batch_are_on_time(spark):
    from pyspark.sql import functions as F

    given = [payload("a", seconds=0), payload("b", seconds=100), payload("old", seconds=1)]
    raw = from_payloads(spark, given).withColumn("arrived", F.when(F.col("offset") < 2, F.col("offset") + 1))
    streams = assemble(raw, arrival_batch="arrived")
    assert sorted(r["transaction_id"] for r in streams.outcomes.collect()) == ["a", "b", "old"]


def test_the_first_arrival_wins(spark):
    from pyspark.sql import functions as F

    given = [payload("x", seconds=5, amount=7), payload("x", seconds=0, amount=3), payload("y", seconds=400)]
    raw = from_payloads(spark, given).withColumn("arrived", F.element_at(F.array(*map(F.lit, (3, 1, 2))), (F.col("offset") + 1).cast("int")))
    rows = {r["transaction_id"]: r for r in assemble(raw, arrival_batch="arrived").persistable.collect()}
    assert (rows["x"]["status"], int(rows["x"]["amount"])) == ("PROCESSED", 3)


def test_running_maximum_over_groups_of_batches(spark):
    import random

    from riskloom.operators.lateness import batch_watermarks

    rng = random.Random(4)
    numbers = [rng.choice([rng.randrange(9), rng.randrange(-(2**40), 2**40), 2**62 + rng.randrange(5)]) for _ in range(60)]
    newest = {b: rng.randrange(1000) for b in numbers}
    df = spark.createDataFrame([(b, v) for b, v in newest.items()], "batch long, ts_ms long")
    found = {r["batch"]: r["watermark_ms"] for r in batch_watermarks(df, "batch", 10).collect()}
    order = sorted(newest)
    assert found == {b: (max(newest[x] for x in order[:k]) - 10 if k else None) for k, b in enumerate(order)}
