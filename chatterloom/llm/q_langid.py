"""op6: language of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.llm import langid
from chatterloom.llm.registry import query
from chatterloom.llm.shared import fold, table


@query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), langid.FOLDS) == langid.HELD_OUT
    return langid.identify(docs, langid.fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
