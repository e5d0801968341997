"""op11: exact clusters of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatterloom.llm.registry import query
from chatterloom.llm.shared import table
from chatterloom.llm.simplex import centroid_hash, clustered

ROUNDS = 10


def _sql() -> str:
    """Centroids ``c0`` to ``c10``, each as one row (c, v); ``a<i>`` holds the assignment to ``c<i>``."""
    steps = [
        """v AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v
  FROM v QUALIFY c < 8)""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT uid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT uid, c,
  CAST(list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c{i}.v[i]) * (v.v[i] - c{i}.v[i]))) AS BIGINT) AS d FROM v, c{i}) GROUP BY uid)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT c, list(m ORDER BY i) AS v FROM (
  SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
  SELECT a{i}.c, unnest(v.v) AS x, unnest(range(1, 65)) AS i FROM a{i} JOIN v USING (uid)) GROUP BY c, i)) GROUP BY c) m ON m.c = c{i}.c)"""
            )
    last = f"a{ROUNDS}"
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, CAST({last}.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY {last}.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM {last} JOIN v USING (uid) JOIN c{ROUNDS} ON c{ROUNDS}.c = {last}.c"""


@query("op11_centroid_clustering", _sql())
def centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(table(spark, sf_dir, "embeddings"), rounds=ROUNDS)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid_hash(found["centroid"]).alias("centroid_sha256"))
