"""Query op7_warc and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import warc
from riskloom.llm.shared import stored, table


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages, reads them back, and gives revisits the size of the response that they refer to."""
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    number = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    records = warc.read_archives(manifest, folder).select(
        number(F.col("record_id")).alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )
    records = stored(records, "warc-records")
    whole = records.filter("record_type <> 'revisit'")
    # copies of a response agree in id, digest and size; one of them answers for all
    sizes = whole.filter("record_type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("same")).agg(F.max("payload_bytes").alias("size"))
    revisits = records.filter("record_type = 'revisit'")
    met = revisits.join(sizes, (revisits["refers_to"] == sizes["of"]) & (revisits["payload_digest"] == sizes["same"]), "left")
    return whole.unionAll(met.select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


SQL = """
WITH sized AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), grouped AS (
    SELECT hex, max(page_id) AS keeper FROM sized GROUP BY hex
), digits AS (
    SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((part >> (15 - 5 * digit)) & 31)::INT, 1), '' ORDER BY place, digit) AS digest
    FROM (SELECT hex, place, ('0x' || substr(hex, 1 + 5 * place, 5))::INT AS part
          FROM grouped, (SELECT unnest(range(8))::INT AS place)), (SELECT unnest(range(4))::INT AS digit)
    GROUP BY hex
)
SELECT s.page_id, s.payload_bytes, d.digest AS payload_digest,
       CASE WHEN s.page_id = g.keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN s.page_id = g.keeper THEN NULL ELSE g.keeper END AS refers_to
FROM sized s JOIN grouped g ON g.hex = s.hex JOIN digits d ON d.hex = s.hex
"""
