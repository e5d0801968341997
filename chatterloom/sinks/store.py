"""Stored posts, comments, page profiles and feedback as partitioned parquet."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.functions.text import compose_letters
from chatterloom.operators.scale import broadcast_if_small, last_per_key


def _refuse_others(rows: DataFrame, wanted: DataFrame) -> None:
    if not rows.join(wanted, "page_id", "left_anti").isEmpty():
        raise ValueError("rows of pages that are not being replaced")


def replace_pages(rows: DataFrame, path: str, pages: Sequence[int], content: str) -> None:
    """Replace all rows of the listed pages by ``rows``; other pages stay untouched.

    Only partitions of listed pages are rewritten. A listed page without new rows gets a mark that
    readers skip. Rows of unlisted pages are refused. The rebalance hint splits a hot page over
    several files and joins small ones.
    """
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(p,) for p in pages], "page_id bigint")
    _refuse_others(rows, wanted)
    corrected = rows.withColumn(content, compose_letters(F.col(content))).withColumn("_emptied", F.lit(False))
    empty = wanted.join(rows.select("page_id").distinct(), "page_id", "left_anti")
    marks = empty.select(
        *[
            F.lit(True).alias(c) if c == "_emptied" else F.col(c) if c == "page_id" else F.lit(None).cast(corrected.schema[c].dataType).alias(c)
            for c in corrected.columns
        ]
    )
    (
        corrected.unionByName(marks)
        .hint("rebalance", "page_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("page_id")
        .parquet(path)
    )


def save_posts(posts: DataFrame, path: str, pages: Sequence[int]) -> None:
    replace_pages(posts, path, pages, "post_content")


def save_comments(comments: DataFrame, path: str, pages: Sequence[int]) -> None:
    replace_pages(comments, path, pages, "comment_content")


def save_batch(posts: DataFrame, comments: DataFrame, posts_path: str, comments_path: str, pages: Sequence[int]) -> None:
    """Posts first, then comments, for the same pages."""
    save_posts(posts, posts_path, pages)
    save_comments(comments, comments_path, pages)


def _files(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def commit_batch(posts: DataFrame, comments: DataFrame, path: str, pages: Sequence[int]) -> int:
    """Replace the posts and comments of the listed pages together; returns the number of the new version.

    Both are written aside, below a batch name that no reader knows yet. Then a manifest that names the batch of every page is
    written aside too and renamed to the next version: one step, which makes all of it visible. A write that is killed before
    leaves the old version whole, and one that another writer has overtaken fails. Batches that older
    versions name stay. A listed page without new rows is empty afterwards; rows of unlisted pages are refused.
    """
    spark, batch = posts.sparkSession, uuid.uuid4().hex
    wanted = spark.createDataFrame([(p,) for p in pages], "page_id bigint")
    for rows in (posts, comments):
        _refuse_others(rows, wanted)
    version = latest_version(spark, f"{path}/committed")
    for kind, rows, content in (("posts", posts, "post_content"), ("comments", comments, "comment_content")):
        corrected = rows.withColumn(content, compose_letters(F.col(content))).hint("rebalance", "page_id")
        corrected.write.partitionBy("page_id").parquet(f"{path}/{kind}/batch={batch}")
    manifest = wanted.distinct().withColumn("batch", F.lit(batch))
    if version is not None:
        manifest = manifest.unionByName(_manifest(spark, path, version).join(wanted, "page_id", "left_anti"))
    aside, number = f"{path}/committed/_next-{batch}", 0 if version is None else version + 1
    manifest.write.parquet(aside)
    source, files = _files(spark, aside)
    target, _ = _files(spark, f"{path}/committed/version={number}")
    if files.exists(target) or not files.rename(source, target):
        raise RuntimeError(f"version {number} was written by another batch")
    return number


def _manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("page_id bigint, batch string").parquet(f"{path}/committed/version={version}")


def read_committed(spark: SparkSession, path: str, kind: str, schema: str, version: int | None = None) -> DataFrame:
    """Rows (``posts`` or ``comments``) of a committed version, the newest by default; ``schema`` names the columns beside the page.

    The manifest prunes the folders that are read. Nothing committed is no rows.
    """
    version = latest_version(spark, f"{path}/committed") if version is None else version
    whole = f"{schema}, page_id bigint, batch string"
    if version is None:
        return spark.createDataFrame([], whole).drop("batch")
    rows = spark.read.schema(whole).parquet(f"{path}/{kind}")
    return rows.join(broadcast_if_small(_manifest(spark, path, version)), ["page_id", "batch"]).drop("batch")


def upserted(stored: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Stored rows with the batch applied; of several batch rows for a key the last one wins."""
    last = last_per_key(batch, [key], order).select(*stored.columns)
    return stored.join(last.select(key), key, "left_anti").unionByName(last)


def save_profiles(batch: DataFrame, path: str, order: str, key: str = "page_id") -> int:
    """Write the next version of the profile table next to the current one; returns its number."""
    spark = batch.sparkSession
    version = latest_version(spark, path)
    fresh = last_per_key(batch, [key], order)
    state = fresh if version is None else upserted(read_profiles(spark, path), batch, key, order)
    number = 0 if version is None else version + 1
    state.write.mode("overwrite").parquet(f"{path}/version={number}")
    return number


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Number of the newest complete version, from the folder listing alone."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")) if files.exists(root) else []
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=None)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={latest_version(spark, path)}")


def append_feedback(feedback: DataFrame, path: str) -> None:
    feedback.select("feedback_content", "feedback_label").write.mode("append").parquet(path)
