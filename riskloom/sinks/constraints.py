"""Table constraints as a column, so that records a table would reject are set aside instead of failing a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import model as m

# Column widths of the stored tables.
_MAX_LENGTH = {"transaction_id": 100, "customer_id": 100, "merchant_id": 100, "currency": 3, "country": 2}
_REQUIRED = ("transaction_id", "customer_id", "merchant_id", "amount", "currency", "timestamp")


def rejection(events: DataFrame) -> Column:
    """Why a table would refuse the row, or NULL.  Trailing blanks do not count towards a width."""
    checks = [F.when(F.col(name).isNull(), F.lit(f"{name} must not be null")) for name in _REQUIRED]
    for name, width in _MAX_LENGTH.items():
        checks.append(F.when(F.length(F.rtrim(F.col(name))) > width, F.lit(f"{name} is longer than {width}")))
        checks.append(F.when(F.contains(F.col(name), F.lit("\x00")), F.lit(f"{name} contains a null character")))
    too_wide = F.round("amount", m.TABLE_MONEY.scale).try_cast(m.TABLE_MONEY).isNull() & F.col("amount").isNotNull()
    checks.append(F.when(too_wide, F.lit("amount does not fit NUMERIC(19,4)")))
    checks.append(
        F.when(
            F.col("risk_score").isNotNull() & ~F.col("risk_score").between(0, m.MAX_SCORE),
            F.lit("risk_score must be within 0..100"),
        )
    )
    return F.coalesce(*checks)


def split_rejected(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acceptable rows, rejected rows with ``rejection``)."""
    marked = events.withColumn("rejection", rejection(events))
    return marked.where(F.col("rejection").isNull()).drop("rejection"), marked.where(F.col("rejection").isNotNull())
