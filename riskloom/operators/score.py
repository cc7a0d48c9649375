"""Score, level, reasons and alerts from rows that carry the context columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import model as m


def risk_level(score: Column) -> Column:
    return (
        F.when(score < m.MEDIUM_FROM, F.lit(m.LEVEL_LOW))
        .when(score < m.HIGH_FROM, F.lit(m.LEVEL_MEDIUM))
        .otherwise(F.lit(m.LEVEL_HIGH))
    )


def is_alert(level: Column) -> Column:
    """Only HIGH results raise an alert."""
    return level == m.LEVEL_HIGH


def _checked_points(contribution: Column, name: str, applies: Column) -> Column:
    """A rule that answers with a score outside 0..100 fails the query, as does a rule that raises."""
    score = contribution["score"]
    points = F.when(score.between(0, m.MAX_SCORE), score).otherwise(
        F.raise_error(F.concat(F.lit(f"rule {name}: score must be within 0..100: "), score.cast("string"))).cast("int")
    )
    return F.when(applies & contribution["reason"].isNotNull(), points).otherwise(F.lit(0))


def with_score(contexts: DataFrame, rules: Sequence, applies: Column | None = None) -> DataFrame:
    """Adds ``risk_score``, ``risk_level`` and ``reasons``; reasons follow the order of the rules.

    Rows to which ``applies`` does not apply are not scored: no rule can fail on them, and the three stay NULL.
    """
    applies = F.lit(True) if applies is None else applies
    contributions = [rule.contribution() for rule in rules]
    points = [_checked_points(c, rule.name, applies) for c, rule in zip(contributions, rules)]
    total = reduce(lambda a, b: a + b, points, F.lit(0))
    reasons = F.array_compact(F.array(*[c["reason"] for c in contributions]).cast("array<string>"))
    score = F.col("_score")
    result = F.struct(
        score.alias("risk_score"), F.when(applies, risk_level(score)).alias("risk_level"), F.when(applies, reasons).alias("reasons")
    )
    # A one-row generator: filters on the result must not repeat the rules.
    rows = contexts.withColumn("_score", F.when(applies, F.least(total, F.lit(m.MAX_SCORE))))
    return rows.select(*contexts.columns, F.inline(F.array(result)))


def high_risk_alerts(scored: DataFrame) -> DataFrame:
    """One alert per HIGH result.  It depends on the result alone, so a replay produces the same alert again."""
    return scored.where(is_alert(F.col("risk_level"))).select(
        F.concat(F.lit(m.ALERT_ID_PREFIX), F.col("transaction_id")).alias("alert_id"),
        "transaction_id",
        "customer_id",
        "risk_score",
        "risk_level",
        "reasons",
        F.col("timestamp").alias("transaction_timestamp"),
    )
