"""The corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays, documents
that leak benchmark items go, and the rest is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.op1_toxicity import toxicity_stage
from riskloom.llm.op2_line_dedup import line_stage
from riskloom.llm.op4_decontaminate import benchmark_stage
from riskloom.llm.op5_packing import packing_stage
from riskloom.llm.op6_ngram_join import near_stage
from riskloom.llm.shared import stored, table

STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # trained scores, edit distances and token ids have no SQL form; tests/llm holds brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
