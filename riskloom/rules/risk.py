"""Risk rules: each one turns a transaction row with its context columns into a score contribution.

A rule is a plug-in.  It is configured once from the ``risk.*`` settings and afterwards only builds Column
expressions, so every rule runs inside the same code-generated stage as the rest of the row.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from typing import Protocol, runtime_checkable

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import model as m


@runtime_checkable
class RiskRule(Protocol):
    """What a risk plug-in provides."""

    name: str

    def configure(self, settings: Mapping[str, str]) -> None: ...

    def contribution(self) -> Column:
        """``STRUCT<score INT, reason STRING>``; a NULL reason means the rule did not trigger."""


class ThresholdRule:
    """A rule with one fixed score and reason and a boolean condition."""

    name: str
    score: int
    reason: str

    def __init__(self) -> None:
        if not 0 <= self.score <= m.MAX_SCORE:
            raise ValueError(f"score must be within 0..100: {self.score}")

    def configure(self, settings: Mapping[str, str]) -> None:
        """Keys a rule does not know are ignored; absent keys keep the current value."""

    def condition(self) -> Column:
        raise NotImplementedError

    def contribution(self) -> Column:
        hit = F.coalesce(self.condition(), F.lit(False))
        return F.struct(
            F.when(hit, F.lit(self.score)).otherwise(F.lit(0)).alias("score"),
            F.when(hit, F.lit(self.reason)).alias("reason"),
        )


def _not_declined() -> Column:
    return ~F.col("payment_status").eqNullSafe(m.DECLINED)


def _money(value: Decimal) -> Column:
    return F.lit(value)


def _above_average(multiplier: Decimal, min_history: int) -> Column:
    average = F.col("average_recent_amount")
    return (
        (average > 0)
        & (F.col("recent_transaction_count") >= min_history)
        & (F.col("amount") > average * _money(multiplier))
    )


# Fixed values in the classes below: names (they set the order), scores, reasons, setting keys and defaults.


class AmountAnomaly(ThresholdRule):
    """An amount far above the customer's recent average."""

    name = "amount-anomaly"
    score = 30
    reason = "UNUSUAL_AMOUNT"

    def __init__(self, multiplier: str | Decimal = "5", min_history: int = 3) -> None:
        super().__init__()
        self.multiplier = Decimal(multiplier)
        self.min_history = min_history

    def configure(self, settings: Mapping[str, str]) -> None:
        self.multiplier = Decimal(settings.get("risk.anomaly-multiplier", self.multiplier))
        self.min_history = int(settings.get("risk.anomaly-min-history", self.min_history))

    def condition(self) -> Column:
        return _above_average(self.multiplier, self.min_history)


class FailedAttemptsThenSuccess(ThresholdRule):
    """An approved attempt after several declined ones in five minutes."""

    name = "failed-attempts-then-success"
    score = 40
    reason = "FAILED_ATTEMPTS_THEN_SUCCESS"

    def __init__(self, min_declined: int = 3) -> None:
        super().__init__()
        self.min_declined = min_declined

    def configure(self, settings: Mapping[str, str]) -> None:
        self.min_declined = int(settings.get("risk.max-declined-per-five-minutes", self.min_declined))

    def condition(self) -> Column:
        return _not_declined() & (F.col("declined_last_five_minutes") >= self.min_declined)


class GeographicImpossibility(ThresholdRule):
    """A different country than the previous attempt's, too soon to have travelled."""

    name = "geographic-impossibility"
    score = 50
    reason = "GEOGRAPHIC_IMPOSSIBILITY"

    def __init__(self, window_minutes: int = 10) -> None:
        super().__init__()
        self.window_minutes = window_minutes

    def configure(self, settings: Mapping[str, str]) -> None:
        self.window_minutes = int(settings.get("risk.impossible-travel-minutes", self.window_minutes))

    def condition(self) -> Column:
        return (F.col("country") != F.col("previous_country")) & (
            F.col("time_since_previous_ms") < F.lit(self.window_minutes * m.MINUTE_MS).cast("bigint")
        )


class NewCountryHighAmount(ThresholdRule):
    """An approved high amount from a country that the kept history has not seen."""

    name = "new-country-high-amount"
    score = 40
    reason = "NEW_COUNTRY_HIGH_AMOUNT"

    def __init__(self, multiplier: str | Decimal = "2", min_history: int = 3) -> None:
        super().__init__()
        self.multiplier = Decimal(multiplier)
        self.min_history = min_history

    def configure(self, settings: Mapping[str, str]) -> None:
        self.multiplier = Decimal(settings.get("risk.new-country-amount-multiplier", self.multiplier))
        self.min_history = int(settings.get("risk.new-country-min-history", self.min_history))

    def condition(self) -> Column:
        unseen = ~F.array_contains(F.col("known_countries"), F.col("country"))
        return _not_declined() & unseen & _above_average(self.multiplier, self.min_history)


class SpendingVelocity(ThresholdRule):
    """More than a given sum spent in ten minutes; currencies are added as plain numbers."""

    name = "spending-velocity"
    score = 40
    reason = "HIGH_SPENDING_VELOCITY"

    def __init__(self, max_amount: str | Decimal = "5000") -> None:
        super().__init__()
        self.max_amount = Decimal(max_amount)

    def configure(self, settings: Mapping[str, str]) -> None:
        self.max_amount = Decimal(settings.get("risk.max-amount-per-ten-minutes", self.max_amount))

    def condition(self) -> Column:
        return F.col("amount_last_ten_minutes") > _money(self.max_amount)


class TransactionVelocity(ThresholdRule):
    """More attempts in one minute than allowed, the current one included."""

    name = "transaction-velocity"
    score = 40
    reason = "HIGH_TRANSACTION_VELOCITY"

    def __init__(self, max_per_minute: int = 5) -> None:
        super().__init__()
        self.max_per_minute = max_per_minute

    def configure(self, settings: Mapping[str, str]) -> None:
        self.max_per_minute = int(settings.get("risk.max-transactions-per-minute", self.max_per_minute))

    def condition(self) -> Column:
        return F.col("transactions_last_minute") > self.max_per_minute


BUILT_IN = (
    AmountAnomaly,
    FailedAttemptsThenSuccess,
    GeographicImpossibility,
    NewCountryHighAmount,
    SpendingVelocity,
    TransactionVelocity,
)
