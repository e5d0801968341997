"""Posts, comments and pages from a relational database or from parquet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str],
    split_column: str,
    lower: int,
    upper: int,
    partitions: int,
) -> DataFrame:
    """A table read in ``partitions`` ranges of ``split_column``; later filters reach the database."""
    return spark.read.jdbc(
        url, table, column=split_column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=dict(properties)
    )


def read_pages_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a table written by ``sinks.store``, without the marks of emptied pages."""
    stored = spark.read.parquet(path)
    return stored.where("NOT _emptied").drop("_emptied")
