"""First occurrence per transaction id, for bounded input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import model as m


def first_per_transaction(transactions: DataFrame, arrival: Sequence[str | Column] = m.COORDINATES) -> DataFrame:
    """Keeps the first row of each ``transaction_id`` by ``arrival`` order, whatever the later ones contain.

    Filtering on ``row_number() = 1`` lets Spark keep one row per id on the map side already, so an id that repeats a
    great many times does not travel.
    """
    order = Window.partitionBy("transaction_id").orderBy(*arrival)
    return transactions.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") == 1).drop("_nth")
