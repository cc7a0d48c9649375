"""Query op3_secrets.

The tables hold no labelled findings, so the query labels a part of the findings itself by a stated rule: a candidate of mixed
characters that is assigned in quotes to a secret-like word is one (1); a candidate made of word pieces, or named as a
digest or identifier, is none (0). All others have no label; for them, and for the rest, the forest decides. Only findings of
documents with crc32(doc_id) mod 3 = 0 are learned from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import secret_scan as s
from riskloom.llm.shared import stored, table


def stated_label() -> Column:
    mixed = (F.col("f_digits") > 0.1) & (F.col("f_covered") < 0.5)
    secret = mixed & (F.col("f_assigned") == 1) & (F.col("f_quoted") == 1) & (F.col("f_secret_word") == 1)
    other = (F.col("f_covered") >= 0.8) | ((F.col("f_other_word") == 1) & (F.col("f_secret_word") == 0))
    return F.when(secret, 1).when(other, 0)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    pieces = stored(s.word_pieces(docs), "word-pieces")
    featured = stored(s.with_features(s.findings(docs), pieces), "findings")
    learned = featured.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 0).withColumn("label", stated_label())
    judged = s.judge(featured, s.fit(learned, pieces))
    return judged.select(
        F.col("id").alias("doc_id"),
        "start",
        F.length("candidate").alias("length"),
        F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"),
        "probability",
        (F.col("probability") >= 0.5).cast("int").alias("is_secret"),
    )
