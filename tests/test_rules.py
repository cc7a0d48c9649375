from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskloom import model as m
from riskloom.operators.score import high_risk_alerts, risk_level, with_score
from riskloom.rules import registry, risk

FIELDS = (
    "transaction_id string, customer_id string, amount decimal(28,8), country string, payment_status string, "
    "timestamp timestamp, transactions_last_minute long, amount_last_ten_minutes decimal(32,8), previous_country string, "
    "recent_countries array<string>, average_recent_amount decimal(28,4), recent_transaction_count long, "
    "time_since_previous_ms long, known_countries array<string>, declined_last_five_minutes long"
)
CALM = {
    "transaction_id": "t",
    "customer_id": "c",
    "amount": Decimal(10),
    "country": "PT",
    "payment_status": None,
    "timestamp": None,
    "transactions_last_minute": 1,
    "amount_last_ten_minutes": Decimal(10),
    "previous_country": None,
    "recent_countries": [],
    "average_recent_amount": None,
    "recent_transaction_count": 0,
    "time_since_previous_ms": None,
    "known_countries": [],
    "declined_last_five_minutes": 0,
}


def fired(spark, rule, *changes):
    rows = [tuple((CALM | change | {"transaction_id": str(i)}).values()) for i, change in enumerate(changes)]
    df = spark.createDataFrame(rows, FIELDS)
    out = df.withColumn("_hit", rule.contribution()).orderBy(F.col("transaction_id").cast("int"))
    return [r["_hit"]["reason"] is not None for r in out.collect()]


def history(average, count, amount, **more):
    return {
        "average_recent_amount": None if average is None else Decimal(average),
        "recent_transaction_count": count,
        "amount": None if amount is None else Decimal(amount),
    } | more


def test_amount_anomaly(spark):
    got = fired(
        spark,
        risk.AmountAnomaly(),
        history("10", 3, "50"),
        history("10", 3, "50.00000001"),
        history("10", 2, "500"),
        history("0", 3, "500"),
        history(None, 0, "500"),
        history("10", 3, None),
        history("10", 3, "51", payment_status="DECLINED"),
    )
    assert got == [False, True, False, False, False, False, True]


def test_failed_attempts(spark):
    declined = "declined_last_five_minutes"
    got = fired(
        spark,
        risk.FailedAttemptsThenSuccess(),
        {declined: 2},
        {declined: 3},
        {declined: 3, "payment_status": "APPROVED"},
        {declined: 5, "payment_status": "DECLINED"},
    )
    assert got == [False, True, True, False]


def test_geographic_impossibility(spark):
    def trip(previous, since, country="PT"):
        return {"previous_country": previous, "time_since_previous_ms": since, "country": country}

    got = fired(
        spark,
        risk.GeographicImpossibility(),
        trip("US", 599_999),
        trip("US", 600_000),
        trip("PT", 1),
        trip(None, 1),
        trip("US", None),
        trip("US", 1, None),
    )
    assert got == [True, False, False, False, False, False]


def test_new_country(spark):
    known = {"known_countries": ["PT"], "country": "US"}
    got = fired(
        spark,
        risk.NewCountryHighAmount(),
        history("20", 3, "40", **known),
        history("20", 3, "40.01", **known),
        history("20", 3, "100", known_countries=["PT", "US"], country="US"),
        history("20", 2, "100", **known),
        history("20", 3, "100", **known, payment_status="DECLINED"),
        history("20", 3, "100", known_countries=["PT"], country=None),
        history("20", 3, "100", known_countries=[], country="US"),
    )
    assert got == [False, True, False, False, False, False, True]


def test_velocities(spark):
    spent = "amount_last_ten_minutes"
    assert fired(spark, risk.SpendingVelocity(), {spent: Decimal(5000)}, {spent: Decimal("5000.01")}) == [False, True]
    n = "transactions_last_minute"
    assert fired(spark, risk.TransactionVelocity(), {n: 5}, {n: 6}) == [False, True]


def test_settings_change_known_keys_only(spark):
    rule = risk.TransactionVelocity()
    rule.configure({"risk.max-transactions-per-minute": "2", "risk.other": "x"})
    assert rule.max_per_minute == 2
    rule.configure({})
    assert rule.max_per_minute == 2
    for cls, key, attribute, value in [
        (risk.AmountAnomaly, "risk.anomaly-multiplier", "multiplier", Decimal("2.5")),
        (risk.AmountAnomaly, "risk.anomaly-min-history", "min_history", 7),
        (risk.FailedAttemptsThenSuccess, "risk.max-declined-per-five-minutes", "min_declined", 4),
        (risk.GeographicImpossibility, "risk.impossible-travel-minutes", "window_minutes", 30),
        (risk.NewCountryHighAmount, "risk.new-country-amount-multiplier", "multiplier", Decimal("3")),
        (risk.NewCountryHighAmount, "risk.new-country-min-history", "min_history", 1),
        (risk.SpendingVelocity, "risk.max-amount-per-ten-minutes", "max_amount", Decimal("99.5")),
    ]:
        configured = cls()
        configured.configure({key: str(value)})
        assert getattr(configured, attribute) == value


def test_registry_sorts_and_insists_on_rules():
    assert [r.name for r in registry.risk_rules()] == [
        "amount-anomaly",
        "failed-attempts-then-success",
        "geographic-impossibility",
        "new-country-high-amount",
        "spending-velocity",
        "transaction-velocity",
    ]
    assert [r.name for r in registry.validation_rules()] == [
        "MinimumAmountRule",
        "RequiredFieldsRule",
        "SupportedCurrencyRule",
    ]
    with pytest.raises(RuntimeError):
        registry.risk_rules(built_in=False)
    with pytest.raises(RuntimeError):
        registry.validation_rules(built_in=False)
    with pytest.raises(ValueError):
        registry.risk_rules(extra=[risk.AmountAnomaly()])
    assert registry.risk_rules({"risk.max-transactions-per-minute": "9"})[-1].max_per_minute == 9


class Points:
    """A plug-in that always triggers."""

    def __init__(self, name, score, reason="R"):
        self.name, self.score, self.reason = name, score, reason

    def configure(self, settings):
        pass

    def contribution(self):
        return F.struct(F.lit(self.score).alias("score"), F.lit(self.reason).alias("reason"))


def scored(spark, *rules):
    return with_score(spark.createDataFrame([tuple(CALM.values())], FIELDS), list(rules))


def test_score_is_summed_capped_and_ordered(spark):
    row = scored(spark, Points("a", 30, "A"), Points("b", 40, "B")).first()
    assert (row["risk_score"], row["risk_level"], row["reasons"]) == (70, "HIGH", ["A", "B"])
    assert scored(spark, Points("a", 60), Points("b", 70)).first()["risk_score"] == 100
    silent = scored(spark, Points("a", 60, None)).first()
    assert (silent["risk_score"], silent["risk_level"], silent["reasons"]) == (0, "LOW", [])


def test_scores_out_of_range_fail(spark):
    with pytest.raises(Exception, match="score must be within"):
        scored(spark, Points("a", 101)).collect()

    class TooMuch(risk.ThresholdRule):
        name, score, reason = "x", 101, "X"

    with pytest.raises(ValueError):
        TooMuch()


def test_level_boundaries(spark):
    df = spark.createDataFrame([(s,) for s in (0, 39, 40, 69, 70, 100)], "s int")
    assert [r[0] for r in df.select(risk_level(F.col("s"))).collect()] == [
        "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH",
    ]


def test_alert_threshold_and_shape(spark):
    assert high_risk_alerts(scored(spark, Points("a", 69))).count() == 0
    row = high_risk_alerts(scored(spark, Points("a", 70, "A"))).first()
    assert (row["alert_id"], row["risk_score"], row["reasons"]) == (m.ALERT_ID_PREFIX + "t", 70, ["A"])
