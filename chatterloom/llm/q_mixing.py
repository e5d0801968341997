"""op5: all documents mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatterloom.llm.mixing import mix
from chatterloom.llm.registry import query
from chatterloom.llm.shared import table

SQL = r"""
WITH a AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
q AS (SELECT *, ((u / (1 - u)) / ln(size + 3)) AS q FROM a),
d AS (SELECT doc_id, source, size, CAST(floor((q / (1 + q)) * 1099511627775.0::DOUBLE) AS BIGINT) AS rank FROM q),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS bound FROM s),
l AS (SELECT *, row_number() OVER o AS nr, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(bound) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM w WINDOW o AS (ORDER BY bound / weight, source NULLS LAST), p AS (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(nr) AS nr, arg_min(level, nr) AS level FROM l WHERE level * weight < bound),
t AS (SELECT l.source, l.source_size, CASE WHEN l.nr < coalesce(f.nr, 1073741824) THEN bound ELSE f.level * weight END AS target FROM l, f),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT *, greatest(target - whole * source_size, 0) AS rest FROM k),
x AS (SELECT d.*, r.source_size, r.target, r.whole, r.rest, sum(size) OVER (PARTITION BY d.source ORDER BY rank RANGE UNBOUNDED PRECEDING) AS upto
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
y AS (SELECT *, upto <= rest AS taken_in, rest - coalesce(max(upto) FILTER (upto <= rest) OVER (PARTITION BY source), 0) AS gap1 FROM x),
f1 AS (SELECT source, arg_max(rank, (size, -rank)) AS rank1, max(size) AS size1 FROM y WHERE NOT taken_in AND size > 0 AND size <= gap1 GROUP BY source),
y2 AS (SELECT y.*, rank1, gap1 - coalesce(size1, 0) AS gap2 FROM y LEFT JOIN f1 ON y.source IS NOT DISTINCT FROM f1.source),
f2 AS (SELECT source, arg_max(rank, (size, -rank)) AS rank2, max(size) AS size2 FROM y2
  WHERE NOT taken_in AND size > 0 AND size <= gap2 AND rank IS DISTINCT FROM rank1 GROUP BY source),
y3 AS (SELECT y2.*, rank2, gap2 - coalesce(size2, 0) AS gap3 FROM y2 LEFT JOIN f2 ON y2.source IS NOT DISTINCT FROM f2.source),
f3 AS (SELECT source, arg_max(rank, (size, -rank)) AS rank3, max(size) AS size3 FROM y3
  WHERE NOT taken_in AND size > 0 AND size <= gap3 AND rank IS DISTINCT FROM rank1 AND rank IS DISTINCT FROM rank2 GROUP BY source),
y4 AS (SELECT y3.*, rank3, gap3 - coalesce(size3, 0) AS gap4 FROM y3 LEFT JOIN f3 ON y3.source IS NOT DISTINCT FROM f3.source),
n AS (SELECT source, rank, CAST(sum(size) AS BIGINT) AS size, max(gap4) AS gap4 FROM y4 WHERE NOT taken_in AND size > 0
  AND rank IS DISTINCT FROM rank1 AND rank IS DISTINCT FROM rank2 AND rank IS DISTINCT FROM rank3 GROUP BY source, rank),
g AS (SELECT source, list_reduce(list({'gap': 0.0::DOUBLE, 'rank': rank, 'size': size, 'took': []::BIGINT[]} ORDER BY rank), lambda a, x:
  CASE WHEN x.size <= a.gap THEN {'gap': a.gap - x.size, 'rank': a.rank, 'size': a.size, 'took': list_append(a.took, x.rank)} ELSE a END,
  {'gap': CAST(max(gap4) AS DOUBLE), 'rank': 0::BIGINT, 'size': 0::BIGINT, 'took': []::BIGINT[]}).took AS took FROM n WHERE size <= gap4 GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN taken_in OR rank IS NOT DISTINCT FROM rank1
  OR rank IS NOT DISTINCT FROM rank2 OR rank IS NOT DISTINCT FROM rank3 OR coalesce(list_contains(took, rank), false) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM y4 LEFT JOIN g ON y4.source IS NOT DISTINCT FROM g.source
"""


@query("op5_mixing_sources", SQL)
def mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
