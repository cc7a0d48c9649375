"""Query op1_toxicity and the toxicity stage of the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import toxicity
from riskloom.llm.shared import small_batches, table

THRESHOLD = 0.7


def _part(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def trained(spark: SparkSession, documents: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Dictionaries from remainder 0, calibration from remainder 2; remainder 1 is held out."""
    part = _part(F.col("doc_id"))
    labels = table(spark, sf_dir, "labels").filter(part != 1)
    return toxicity.fit(documents, labels.select("doc_id", F.col("toxic").alias("label"), (part == 2).alias("calibrates")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(spark, documents, sf_dir)
    score = toxicity.score_column(model, F.col("text"))
    scored = documents.select("doc_id", (_part(F.col("doc_id")) == 1).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold; the model is learned from the labelled rows of the documents at hand."""
    small_batches(spark)
    model = trained(spark, docs, sf_dir)
    return docs.filter(toxicity.score_column(model, docs["text"]) < THRESHOLD)
