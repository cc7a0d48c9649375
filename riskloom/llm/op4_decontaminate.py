"""Query op4_decontaminate and the benchmark stage of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.decontaminate import indexes, leaks, leaks_any
from riskloom.llm.shared import small_batches, table


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indexes(table(spark, sf_dir, "benchmark"))
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), found)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    small_batches(spark)
    found = indexes(table(spark, sf_dir, "benchmark"))
    return docs.filter(~leaks_any(found, docs["text"])) if found else docs
