"""Texts scored as they arrive, with the functions the batch jobs use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stream_texts(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 1_000) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def score_stream(texts: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> None:
    """Score everything that has arrived and append it to ``output``.

    Each micro-batch is one folder that a retry overwrites, so every text is scored exactly once.
    Scoring keeps no state between texts: no watermark is needed.
    """

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    query = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
