"""Graph files: a first line with the number of vertices, then edges or matrix rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.sources.files import number_lines, read_lines


def _rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices from the first line; the lines after it, up to the first blank one."""
    lines = number_lines(read_lines(spark, path))
    n = int(lines.where("line_no = 0").first()["value"].strip())
    end = lines.where("line_no > 0 AND trim(value) = ''").agg(F.min("line_no")).scalar()
    rows = lines.where((F.col("line_no") > 0) & (end.isNull() | (F.col("line_no") < end)))
    return spark.range(n), rows.select("line_no", F.split(F.trim("value"), r"\s+").alias("cells"))


def read_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges ``src, dst``."""
    vertices, rows = _rows(spark, path)
    return vertices, rows.select(*[F.col("cells")[i].cast("bigint").alias(c) for i, c in enumerate(("src", "dst"))])


def read_weighted_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges ``src, dst, weight``."""
    vertices, rows = _rows(spark, path)
    ends = [F.col("cells")[i].cast("bigint").alias(c) for i, c in enumerate(("src", "dst"))]
    return vertices, rows.select(*ends, F.col("cells")[2].cast("double").alias("weight"))


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a 0/1 matrix: a positive cell is an edge."""
    vertices, rows = _rows(spark, path)
    cells = rows.select((F.col("line_no") - 1).alias("src"), F.posexplode("cells").alias("dst", "cell"))
    return vertices, cells.where(F.col("cell").cast("double") > 0).select("src", F.col("dst").cast("bigint").alias("dst"))
