import datetime as dt
from decimal import Decimal

import pytest
from payloads import payload

from riskloom.operators.parse import parse_messages
from riskloom.sources.log import from_payloads

MALFORMED = [
    "not json at all",
    '{"amount":',
    "[1,2,3]",
    '[{"transactionId":"t"}]',
    '"text"',
    "null",
    "17",
    "   ",
    "",
    None,
    b"\xff\xfe\x00\x01",
    b'{"transactionId":"\xff"}',
    '{"amount":"abc"}',
    '{"amount":true}',
    '{"amount":{"a":1}}',
    '{"amount":"1,000"}',
    '{"amount":NaN}',
    '{"amount":0.000000001}',
    '{"amount":1e30}',
    "{'amount':1}",
    '{"timestamp":"yesterday"}',
    '{"timestamp":"2027-03-02"}',
    '{"timestamp":"2027-03-02T08:20:07"}',
    '{"timestamp":"2027-13-02T08:20:07Z"}',
    '{"timestamp":true}',
    '{"transactionId":"t","paymentStatus":"MAYBE"}',
    '{"transactionId":"t","paymentStatus":"approved"}',
    '{"transactionId":"t","paymentStatus":""}',
    '{"transactionId":{"a":1}}',
    '{"country":["PT"]}',
]

# (payload, expected fields)
PARSED = [
    ('{"transactionId":"t","somethingNew":true}', {"transaction_id": "t", "customer_id": None, "amount": None}),
    ('{"amount":0.1}', {"amount": Decimal("0.1")}),
    ('{"amount":"12.50"}', {"amount": Decimal("12.5")}),
    ('{"amount":1.5e3}', {"amount": Decimal("1500")}),
    ('{"amount":12345678901234567890.12345678}', {"amount": Decimal("12345678901234567890.12345678")}),
    ('{"amount":1.1000000000000}', {"amount": Decimal("1.1")}),
    ('{"amount":""}', {"amount": None}),
    ('{"amount":null,"paymentStatus":null}', {"amount": None, "payment_status": None}),
    ('{"transactionId":17}', {"transaction_id": "17"}),
    ('{"country":"{x"}', {"country": "{x"}),
    ('{"country":"{\\"a\\":1}"}', {"country": '{"a":1}'}),
    ('{"transactionId":"t","paymentStatus":"DECLINED"}', {"payment_status": "DECLINED"}),
    ('{"timestamp":"2027-03-02T08:20:07Z"}', {"timestamp": dt.datetime(2027, 3, 2, 8, 20, 7), "ts_ms": 1803975607000}),
    ('{"timestamp":"2027-03-02T10:20:07.123456789+02:00"}', {"timestamp": dt.datetime(2027, 3, 2, 8, 20, 7, 123456)}),
    ('{"timestamp":1803975607}', {"ts_ms": 1803975607000}),
    ('{"timestamp":"1803975607.5"}', {"ts_ms": 1803975607500}),
    ('{"timestamp":1803975607.25}', {"ts_ms": 1803975607250}),
    (' \n {"transactionId":"t"}', {"transaction_id": "t"}),
    ("{}", {"transaction_id": None, "timestamp": None}),
]


def parsed(spark, payloads):
    return parse_messages(from_payloads(spark, payloads)).orderBy("offset").collect()


def test_bad_payloads_become_errors(spark):
    for given, row in zip(MALFORMED, parsed(spark, MALFORMED)):
        assert row["error"] is not None and row["error"].startswith("MALFORMED_PAYLOAD: "), given
        assert "\n" not in row["error"]
        assert row["transaction_id"] is None and row["amount"] is None


def test_good_payloads_are_parsed(spark):
    for (given, expected), row in zip(PARSED, parsed(spark, [p for p, _ in PARSED])):
        assert row["error"] is None, (given, row["error"])
        assert {name: row[name] for name in expected} == expected, given


def test_reasons(spark):
    rows = parsed(spark, ["", None, "[1]", "nope", '{"amount":"abc"}'])
    assert [r["error"].removeprefix("MALFORMED_PAYLOAD: ") for r in rows] == [
        "empty payload",
        "empty payload",
        "payload is not a JSON object",
        "payload is not valid JSON",
        "amount is not a number",
    ]
    assert [r["payload"] for r in rows] == ["", "", "[1]", "nope", '{"amount":"abc"}']


def test_documented_payload_and_coordinates(spark):
    text = payload("p77", "kiosk-4", 333, "18.50")
    row = parse_messages(from_payloads(spark, [text], topic="transaction.events", partition=3)).first()
    assert row["error"] is None
    assert (row["transaction_id"], row["customer_id"], row["amount"]) == ("p77", "kiosk-4", Decimal("18.5"))
    assert (row["topic"], row["partition"], row["offset"], row["payload"]) == ("transaction.events", 3, 0, text)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = parsed(spark, ['{"timestamp":"2026-11-01T05:30:00.250Z"}'])[0]
        assert row["ts_ms"] == 1793511000250
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
