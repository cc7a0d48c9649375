"""Query op6_ngram_join, its SQL, and the near-duplicate stage of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.ngram_join import ngram_join
from riskloom.llm.shared import table


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.withColumn("kept", F.col("doc_id") == F.col("component_id"))


SQL = r"""
WITH RECURSIVE tokens AS (
    SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
    FROM tokens
), classes AS (
    SELECT s, min(doc_id) AS id, count(*) AS copies, len(s) AS size FROM sets WHERE len(s) > 0 GROUP BY s
), grams AS (
    SELECT id, unnest(s) AS g FROM classes
), pairs AS (
    SELECT x.id AS a, y.id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.id < y.id
    JOIN classes p ON p.id = x.id JOIN classes q ON q.id = y.id
    GROUP BY x.id, y.id, p.size, q.size HAVING count(*) >= 0.8 * (p.size + q.size - count(*)) - 1e-9
), both_ways AS (
    SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
    SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a
), least AS (
    SELECT a AS id, min(b) AS other FROM reach GROUP BY a
), counted AS (
    SELECT w.a AS id, count(*) AS class_links, sum(c.copies) AS links FROM both_ways w JOIN classes c ON c.id = w.b GROUP BY w.a
)
SELECT d.doc_id, coalesce(c.id, d.doc_id) AS class_id,
       CAST(coalesce(n.links, 0) + coalesce(c.copies - 1, 0) AS BIGINT) AS n_links,
       coalesce(n.class_links, 0) AS n_class_links,
       least(coalesce(l.other, d.doc_id), coalesce(c.id, d.doc_id)) AS component_id,
       d.doc_id = least(coalesce(l.other, d.doc_id), coalesce(c.id, d.doc_id)) AS kept
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN least l ON l.id = c.id LEFT JOIN counted n ON n.id = c.id
"""


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; documents without id stay."""
    joined = ngram_join(docs)
    gone = joined.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
