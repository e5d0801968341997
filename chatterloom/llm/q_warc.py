"""op7: all pages through archives and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatterloom.llm.registry import query
from chatterloom.llm.shared import stored, table
from chatterloom.llm.warc import archived, histories

SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


@query("op7_warc", SQL)
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = histories(stored(archived(table(spark, sf_dir, "pages")), "warc-index"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
