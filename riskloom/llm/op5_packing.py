"""Query op5_packing and the last stage of the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.packing import pack
from riskloom.llm.shared import table

TOKENIZER = "byte_bpe_50k.json"


def _packed(docs: DataFrame) -> DataFrame:
    return pack(docs, public_tokenizers.path(TOKENIZER))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step"
    )


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _packed(docs)
