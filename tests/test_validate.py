from payloads import payload
from pyspark.sql import functions as F

from riskloom.operators.validate import dead_letters, valid_transactions
from riskloom.plans.assemble import checked_messages
from riskloom.rules.registry import validation_rules
from riskloom.rules.validation import PandasValidationRule
from riskloom.sources.log import from_payloads


def codes(spark, payloads, rules=None):
    rows = checked_messages(from_payloads(spark, payloads), rules).orderBy("offset").collect()
    return [None if r["violations"] is None else [v["code"] for v in r["violations"]] for r in rows]


def messages(spark, payloads, rules=None):
    rows = checked_messages(from_payloads(spark, payloads), rules).orderBy("offset").collect()
    return [[v["message"] for v in r["violations"]] for r in rows]


def test_amount_and_currency_boundaries(spark):
    given = [payload("t", amount=a) for a in ("0.00000001", "0", "-5", "null")]
    given += [payload("t", currency=c) for c in ("EUR", "USD", "GBP", "eur", "JPY")]
    assert codes(spark, given) == [
        [],
        ["AMOUNT_NOT_POSITIVE"],
        ["AMOUNT_NOT_POSITIVE"],
        ["REQUIRED_FIELD_MISSING"],
        [],
        [],
        [],
        ["CURRENCY_NOT_SUPPORTED"],
        ["CURRENCY_NOT_SUPPORTED"],
    ]


def test_message_texts(spark):
    given = [payload("t", amount="-5.50"), payload("t", currency="JPY"), payload("t", merchantId=" ")]
    assert messages(spark, given) == [
        ["amount must be greater than 0 but was -5.5"],
        ["currency not supported: JPY"],
        ["required field is missing or blank: merchantId"],
    ]


def test_every_missing_field_is_reported_in_order(spark):
    [found] = messages(spark, ["{}"])
    assert found[:3] == [
        "transactionId is required (deduplication key)",
        "customerId is required (partition key)",
        "timestamp is required (event time)",
    ]
    assert [text.rsplit(" ", 1)[1] for text in found[3:]] == [
        "transactionId",
        "customerId",
        "merchantId",
        "currency",
        "amount",
        "timestamp",
    ]


def test_blank_means_any_white_space(spark):
    blanks = ["", " ", "\t\n", " ", "　", "\x1f"]
    given = [payload("t", merchantId=b) for b in blanks] + [payload("t", merchantId=" ")]
    assert codes(spark, given) == [["REQUIRED_FIELD_MISSING"]] * len(blanks) + [[]]


def test_invariants_hold_without_any_plugin(spark):
    assert codes(spark, ["{}", payload("t", amount="-1")], rules=[]) == [
        ["PIPELINE_TRANSACTION_ID_MISSING", "PIPELINE_CUSTOMER_ID_MISSING", "PIPELINE_TIMESTAMP_MISSING"],
        [],
    ]


def test_a_failing_python_rule_rejects_only_its_row(spark):
    def check(row):
        if row["merchant_id"] == "boom":
            raise RuntimeError("broken plugin")
        return [("TOO_FAR", "from far away")] if row["country"] == "AU" else []

    rules = validation_rules([PandasValidationRule("AaRule", check)])
    given = [payload("a"), payload("b", merchantId="boom"), payload("c", country="AU", amount="-1")]
    assert codes(spark, given, rules) == [[], ["RULE_ERROR"], ["TOO_FAR", "AMOUNT_NOT_POSITIVE"]]
    assert messages(spark, given, rules)[1][0].startswith("AaRule failed: RuntimeError")


def test_python_rules_see_times_of_any_year(spark):
    def check(row):
        year = None if row["timestamp"] is None else row["timestamp"].year
        return [] if year == 2027 else [(f"YEAR_{year}", "unusual")]

    given = [payload("a"), payload("b", timestamp="9999-12-31T00:00:00Z"), payload("c", timestamp="0002-06-01T00:00:00Z")]
    given.append(payload("d", timestamp="@drop"))
    found = codes(spark, given, [PandasValidationRule("Years", check)])
    assert [c for c in found if c] and found[:3] == [[], ["YEAR_9999"], ["YEAR_2"]]
    assert found[3][-1] == "YEAR_None"


def test_dead_letters(spark):
    bad = payload("bad", amount="-5", currency="JPY")
    given = ["poison", bad, payload("ok")]
    checked = checked_messages(from_payloads(spark, given))
    rows = dead_letters(checked, F.lit("2027-03-02T08:20:07Z").cast("timestamp")).orderBy("offset").collect()
    assert [(r["source"], r["code"], r["transaction_id"], r["payload"], r["offset"]) for r in rows] == [
        ("DESERIALIZATION", "MALFORMED_PAYLOAD", None, "poison", 0),
        ("VALIDATION", "AMOUNT_NOT_POSITIVE,CURRENCY_NOT_SUPPORTED", "bad", bad, 1),
    ]
    assert rows[1]["detail"] == "amount must be greater than 0 but was -5; currency not supported: JPY"
    assert [r["transaction_id"] for r in valid_transactions(checked).collect()] == ["ok"]


def test_a_column_rule_fails_only_where_it_must(spark):
    from riskloom.rules.validation import ColumnValidationRule

    calls = []

    def check(columns):
        ids = columns["transaction_id"].to_pylist()
        calls.append(len(ids))
        if "t5" in ids or "t9" in ids:
            raise RuntimeError("cannot judge")
        return [[("ODD", i)] if i in ("t3", "t8") else [] for i in ids]

    given = [payload(f"t{i}") for i in range(12)]
    found = codes(spark, given, [ColumnValidationRule("Ids", ["transaction_id", "amount"], check)])
    assert [f for f in found if f] and sum("RULE_ERROR" in f for f in found) == 2
    assert sum("ODD" in f for f in found) == 2

    short = codes(spark, given[:3], [ColumnValidationRule("Short", ["transaction_id"], lambda columns: [])])
    assert all("RULE_ERROR" in f for f in short)
