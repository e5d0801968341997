"""Whole-folder jobs: every file with an extension is converted, output stays grouped by file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.operators.corpus import raw_text, untag
from chatterloom.operators.scale import kept_table
from chatterloom.operators.tokenize import token_line, tokenize
from chatterloom.sources.files import read_texts


def _by_file(texts: DataFrame, output: str) -> None:
    """One sub-folder per input file, lines in order; a huge file is written by several tasks."""
    name = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    texts.orderBy("file", "line_no").select(name.alias("name"), F.col("text").alias("value")).write.partitionBy("name").text(output)


def convert_folder(spark: SparkSession, folder: str, output: str, extension: str, convert: Callable[[Column], Column]) -> int:
    """Apply a column expression to every line; returns the number of files."""
    texts = read_texts(spark, folder, extension)
    _by_file(texts.withColumn("text", convert(F.col("text"))), output)
    return texts.select("file").distinct().count()


def untag_folder(spark: SparkSession, folder: str, output: str, extension: str = ".pos") -> int:
    return convert_folder(spark, folder, output, extension, untag)


def raw_text_folder(spark: SparkSession, folder: str, output: str, extension: str = ".txt") -> int:
    return convert_folder(spark, folder, output, extension, raw_text)


def tokenize_folder(
    spark: SparkSession, folder: str, output: str, lexicon: DataFrame, frequencies: DataFrame | None = None, extension: str = ".txt"
) -> DataFrame:
    """Tokenise every line, write the lines by file, report ``n_files, n_tokens``."""
    lines = read_texts(spark, folder, extension, rank="line_id")
    tokens = kept_table(tokenize(lines, "line_id", "text", lexicon, frequencies).select("line_id", "pos", "part", "token"))
    joined = lines.drop("text").join(token_line(tokens, "line_id"), "line_id", "left")
    _by_file(joined.withColumn("text", F.coalesce("text", F.lit(""))), output)
    n_files = lines.agg(F.countDistinct("file")).scalar()
    return tokens.agg(F.count("*").alias("n_tokens")).select(n_files.alias("n_files"), "n_tokens")
