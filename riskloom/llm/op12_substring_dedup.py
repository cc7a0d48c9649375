"""Query op12_substring_dedup and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.shared import table
from riskloom.llm.substring_dedup import remove_repeats


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH parts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), placed AS (
    SELECT doc_id, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM parts
), windows AS (
    SELECT doc_id, pos, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), ' ') AS w,
           count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n
    FROM placed
), firsts AS (
    SELECT doc_id, pos, first_value((doc_id, pos)) OVER (PARTITION BY w ORDER BY doc_id, pos) <> (doc_id, pos) AS later
    FROM windows WHERE n = 20
), judged AS (
    SELECT p.doc_id, p.pos, p.word,
           coalesce(max(CASE WHEN f.later THEN 1 ELSE 0 END)
                    OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS goes
    FROM placed p LEFT JOIN firsts f ON f.doc_id = p.doc_id AND f.pos = p.pos
), left_over AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (goes) AS n_removed,
           coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT goes), '') AS kept
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(l.n_words, 0) AS n_words, coalesce(l.n_removed, 0) AS n_removed, sha256(coalesce(l.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN left_over l ON l.doc_id = d.doc_id
"""
