"""op2: quality of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatterloom.llm.quality import judged
from chatterloom.llm.registry import query
from chatterloom.llm.shared import table


@query("op2_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
