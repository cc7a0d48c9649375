"""Query op13_collocations and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.collocations import mine
from riskloom.llm.shared import table


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents").select("text", "lang"))


SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), cut AS (
    SELECT doc, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS pieces FROM texts
), placed AS (
    SELECT doc, lang, generate_subscripts(pieces, 1) AS piece, unnest(pieces) AS body FROM cut
), split AS (
    SELECT doc, lang, piece, regexp_extract_all(body, '[^\x20\x09]+') AS words FROM placed
), w AS (
    SELECT doc, lang, piece, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM split
), n AS (
    SELECT lang, count(*) AS n FROM w GROUP BY lang
), f1 AS (
    SELECT lang, word, count(*) AS f FROM w GROUP BY lang, word
), runs AS (
    SELECT lang, word AS x, lead(word, 1) OVER p AS y, lead(word, 2) OVER p AS z FROM w
    WINDOW p AS (PARTITION BY doc, piece ORDER BY pos)
), f2 AS (
    SELECT lang, x, y, count(*) AS f FROM runs WHERE y IS NOT NULL GROUP BY lang, x, y
), f3 AS (
    SELECT lang, x, y, z, count(*) AS f FROM runs WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= 10
), holds AS (
    SELECT lang, x, y, max(f) AS most FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY lang, x, y
), two AS (
    SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, a.f AS l, b.f AS r,
           CAST(c.f AS HUGEINT) * c.f * 1000000 // (CAST(a.f AS HUGEINT) * b.f) AS score
    FROM f2 c JOIN f1 a ON a.lang = c.lang AND a.word = c.x JOIN f1 b ON b.lang = c.lang AND b.word = c.y
    LEFT JOIN holds h ON h.lang = c.lang AND h.x = c.x AND h.y = c.y
    WHERE c.f >= 10 AND (h.most IS NULL OR 100 * h.most < 50 * c.f)
), three AS (
    SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z AS phrase, c.f AS a, a.f AS l1, yz.f AS r1, xy.f AS l2, b.f AS r2,
           CAST(c.f AS HUGEINT) * c.f * 1000000 // (CAST(a.f AS HUGEINT) * yz.f) AS s1,
           CAST(c.f AS HUGEINT) * c.f * 1000000 // (CAST(xy.f AS HUGEINT) * b.f) AS s2
    FROM f3 c JOIN f1 a ON a.lang = c.lang AND a.word = c.x JOIN f1 b ON b.lang = c.lang AND b.word = c.z
    JOIN f2 xy ON xy.lang = c.lang AND xy.x = c.x AND xy.y = c.y JOIN f2 yz ON yz.lang = c.lang AND yz.x = c.y AND yz.y = c.z
), every AS (
    SELECT * FROM two
    UNION ALL
    SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM three
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""
