"""Query op2_line_dedup, its SQL, and the line stage of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.line_dedup import dedup_lines
from riskloom.llm.shared import table


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


SQL = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT doc_id, line_no, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), frequent AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT k.doc_id, k.line_no, k.line, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS goes
    FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that other documents keep; ``n_chars`` follows the text."""
    done = dedup_lines(docs)
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
