"""op10: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.llm import toxicity
from chatterloom.llm.registry import query
from chatterloom.llm.shared import fold, table


@query("op10_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = fold(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT
    return toxicity.scores(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )
