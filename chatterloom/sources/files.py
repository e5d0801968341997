"""Line files: lookups, word lists, corpora, training text, sentiment lexicon, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatterloom.functions import text as X
from chatterloom.operators.cleaning import last_meaning


def read_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``file, block, row, value``: all lines of a file or of the flat files of a folder.

    ``(file, block, row)`` sorts lines as they stand in the file, also when a file is read in
    several splits; ``row`` only counts up within a split.
    """
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    lines = reader.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


def number_lines(lines: DataFrame, name: str = "line_no", rank: str | None = None) -> DataFrame:
    """Dense line numbers from 0 per file: position in the split plus the lines of earlier splits.

    Only one count per split is gathered, so one huge file is numbered by many tasks. ``rank`` adds the position from 1
    among the lines of all files in the order of their names.
    """
    splits = lines.groupBy("file", "block").agg(F.min("row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "block", "_first", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if rank is not None:
        earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    # One row per split: the lines stay where they were read.
    numbered = lines.join(F.broadcast(starts), ["file", "block"])
    at = F.col("row") - F.col("_first")
    ranked = [] if rank is None else [(at + F.col("_before") + 1).alias(rank)]
    return numbered.select("file", (at + F.col("_start")).alias(name), *ranked, "value")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Two-column lookup ``key, value`` (tab); no quoting, no trimming, last meaning of a key wins.

    Serves spelling, emoticons, emoji aliases and composed letters. Lines without a tab are dropped.
    """
    parts = F.split("value", "\t", -1)
    pairs = read_lines(spark, path).where(F.contains("value", F.lit("\t"))).select(
        F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("value"), F.struct("file", "block", "row").alias("line")
    )
    return last_meaning(pairs, "line")


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed, non-blank, distinct ``word`` per line: stop words, negations, opinion words."""
    words = read_lines(spark, path).select(X.trimmed(F.col("value")).alias("word"))
    return words.where("word != ''").distinct()


def read_training_text(spark: SparkSession, path: str) -> DataFrame:
    """``label DOUBLE, text`` from tab-separated lines; lines without a number in front are dropped."""
    parts = F.split("value", "\t")
    rows = read_lines(spark, path).select(
        F.get(parts, F.lit(0)).try_cast("double").alias("label"), F.get(parts, F.lit(1)).alias("text")
    )
    return rows.where("label IS NOT NULL AND text IS NOT NULL")


def read_sentiment_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``line, pos, id, pos_score, neg_score, synset_terms, gloss``; rows that do not parse are dropped."""
    parts = F.split("value", "\t")
    at = lambda i: F.get(parts, F.lit(i))
    rows = read_lines(spark, path).select(
        F.struct("file", "block", "row").alias("line"),
        at(0).alias("pos"),
        at(1).alias("id"),
        at(2).try_cast("double").alias("pos_score"),
        at(3).try_cast("double").alias("neg_score"),
        at(4).alias("synset_terms"),
        at(5).alias("gloss"),
    )
    return rows.where("pos_score IS NOT NULL AND neg_score IS NOT NULL AND gloss IS NOT NULL")


def read_corpora(spark: SparkSession, folder: str, pattern: str | None = None, rank: str | None = None) -> DataFrame:
    """``file, pos, token``: every flat file of a folder, one token per line, in order; ``rank`` as in ``number_lines``."""
    numbered = number_lines(read_lines(spark, folder, pattern), "pos", rank)
    return numbered.withColumnRenamed("value", "token")


def read_texts(spark: SparkSession, folder: str, extension: str = ".txt", rank: str | None = None) -> DataFrame:
    """``file, line_no, text`` of all files of a folder with the given extension; ``rank`` as in ``number_lines``."""
    numbered = number_lines(read_lines(spark, folder, f"*{extension}"), rank=rank)
    return numbered.withColumnRenamed("value", "text")


def read_lexicon_xml(spark: SparkSession, path: str) -> DataFrame:
    """``content, msd`` of the ``<w msd="...">content</w>`` records."""
    rows = spark.read.format("xml").option("rowTag", "w").schema("_VALUE string, _msd string").load(path)
    return rows.select(F.col("_VALUE").alias("content"), F.col("_msd").alias("msd"))
