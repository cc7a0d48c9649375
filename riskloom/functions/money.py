"""Exact decimal arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import model as m


def half_up_average(total: Column, count: Column) -> Column:
    """``total / count`` rounded once, half away from zero, to four places; NULL when ``count`` is 0.

    Plain ``round(total / count, 4)`` rounds twice, because decimal division first rounds to its own scale.  Taking the
    exact remainder off first leaves a division without a fraction.
    """
    n = F.when(count > 0, count).cast("decimal(3,0)")
    ten_thousandths = F.abs(total).cast("decimal(31,8)") * F.lit(10_000).cast("decimal(5,0)")
    raised = (ten_thousandths + n * F.lit("0.5").cast("decimal(1,1)")).cast("decimal(38,8)")
    whole = ((raised - raised % n) / n).cast("decimal(28,0)")
    rounded = (whole * F.lit("0.0001").cast("decimal(4,4)")).cast(m.AVERAGE)
    return F.when(total < 0, -rounded).otherwise(rounded)
