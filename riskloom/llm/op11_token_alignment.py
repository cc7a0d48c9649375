"""Query op11_token_alignment."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.shared import table
from riskloom.llm.token_alignment import align

TOKENIZER = "byte_bpe_50k.json"
MODEL = "piece_bpe_32k.model"


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(documents, public_tokenizers.path(TOKENIZER), public_tokenizers.path(MODEL))
