"""Query op10_pii."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.pii import pseudonymize
from riskloom.llm.shared import table

KEY = "surrogates of this corpus"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    return done.select(F.col("row.doc_id").alias("doc_id"), F.col("replaced").alias("text"), F.size("kinds").cast("long").alias("n_entities"), "kinds")
