"""Posts, comments and pages: filters, the post-comment join, nesting and its reverse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.operators.scale import INLINE_ROWS, NEST_ROWS, broadcast_if_small, cut_lineage, global_rank, hot_keys, split_left_join

POST_KEY = ["page_id", "post_id"]


def posts_of_pages(posts: DataFrame, pages: Sequence[int] | DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Posts of the given pages, dates inclusive. Both filters reach the scan.

    A list of ids becomes an ``IN`` filter; a DataFrame of ids a semi-join.
    """
    if isinstance(pages, DataFrame):
        posts = posts.join(broadcast_if_small(pages.select("page_id").distinct()), "page_id", "left_semi")
    elif len(pages) <= INLINE_ROWS:
        posts = posts.where(F.col("page_id").isin(list(pages)))
    else:
        ids = posts.sparkSession.createDataFrame([(p,) for p in pages], "page_id bigint")
        return posts_of_pages(posts, ids, start, end)
    if start is not None:
        posts = posts.where(F.col("date_time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        posts = posts.where(F.col("date_time") <= F.lit(end).cast("timestamp"))
    return posts


def post_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Every post with each of its comments, whatever their ids; posts without comments stay, with nulls."""
    return split_left_join(posts, comments, POST_KEY)


def dated(content: Column, date_time: Column) -> Column:
    """Text with its date in front; text whose date is unknown becomes null."""
    return F.concat(F.date_format(date_time, "MM/dd/yyyy"), F.lit("\n"), content)


def parse_date(text: Column) -> Column:
    """First ten characters as a date; null if they are none."""
    return F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))


def number_posts(posts: DataFrame, page: str = "page_id", post: str = "post_id", name: str = "index") -> DataFrame:
    """Number the posts of a page from 0 in order of their id, however the ids are spread; a null page is a page."""
    return global_rank(posts, [F.col(post)], [page], name, start=0)


def nest_comments(posts: DataFrame, comments: DataFrame, size: int = NEST_ROWS) -> DataFrame:
    """One record per post with its comments in id order (null ids first).

    A post with more than ``size`` comments continues in further rows (``part`` 1, 2, ...), so a single hot post
    neither fills one task nor one row. Parts follow the position of a comment in its post, not its id; only comments of such posts are
    ranked for it. Comments are nested before they meet the posts; none is lost, whatever its id.
    """
    filled = comments.where(F.col("comment_content").isNotNull())
    hot = cut_lineage(hot_keys(filled, POST_KEY, size)).select(*POST_KEY)
    placed = filled.withColumn("part", F.lit(0).cast("bigint"))
    if not hot.isEmpty():
        keys = broadcast_if_small(hot)
        order = [F.col("comment_id").asc_nulls_first(), F.col("comment_content")]
        many = global_rank(filled.join(keys, POST_KEY, "left_semi"), order, POST_KEY, "part", start=0)
        placed = placed.join(keys, POST_KEY, "left_anti").unionByName(many.withColumn("part", F.floor(F.col("part") / size)))
    own = F.struct("comment_id", F.col("comment_content").alias("text"))
    nested = placed.groupBy(*POST_KEY, "part").agg(F.sort_array(F.collect_list(own)).alias("comments"))
    none = F.array().cast("array<struct<comment_id:bigint,text:string>>")
    comments_column = F.coalesce(F.col("comments").cast("array<struct<comment_id:bigint,text:string>>"), none)
    joined = posts.join(nested, POST_KEY, "left")
    return joined.withColumn("comments", comments_column).withColumn("part", F.coalesce("part", F.lit(0)))


def unnest_texts(nested: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One text per row: the post (kind ``status``, from its part 0) and each comment (kind ``comment``).

    Both come out of one pass over the record, so nothing is read or shuffled twice.
    """
    status = F.when(
        F.coalesce(F.col("part"), F.lit(0)) == 0,
        F.array(F.struct(F.lit("status").alias("kind"), F.lit(None).cast("bigint").alias("comment_id"), F.col("status").alias("text"))),
    ).otherwise(F.array().cast("array<struct<kind:string,comment_id:bigint,text:string>>"))
    comments = F.transform(
        "comments",
        lambda c: F.struct(F.lit("comment").alias("kind"), c["comment_id"].cast("bigint").alias("comment_id"), c["text"].alias("text")),
    )
    return nested.select(*keys, F.explode(F.concat(status, comments)).alias("_t")).select(*keys, "_t.*")


def documents_of_topic(ranked: DataFrame, nested: DataFrame, topic_id: int) -> DataFrame:
    """Posts with comments of one topic, with the rank the topic gives them."""
    wanted = ranked.where(F.col("topic_id") == topic_id).select("doc_id", "rank")
    return nested.join(wanted, "doc_id")
