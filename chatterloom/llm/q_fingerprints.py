"""op1: fingerprints of all documents and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.llm.fingerprints import as_text, edited_fingerprints, likeness, within_radius
from chatterloom.llm.registry import query
from chatterloom.llm.shared import stored, table


@query("op1_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the fingerprints: for ids divisible by 20 the number of other documents within the radius, else null."""
    prints = stored(edited_fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    counted = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    asked = F.col("doc_id") % 20 == 0
    found = within_radius(prints.where(asked), counted).join(counted.withColumnRenamed("fingerprint", "found"), "found")
    near = found.groupBy(F.col("query").alias("fingerprint")).agg((F.sum("n") - 1).alias("n_near"))
    return prints.join(near, "fingerprint", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
        F.when(asked, F.col("n_near")).alias("n_near"),
    )
