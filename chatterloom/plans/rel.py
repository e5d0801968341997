"""Relational queries: orders as posts, line items as comments; conversations as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.operators import relational as R
from chatterloom.plans.registry import query, table

PAGES = 20


def order_posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        (F.col("o_orderkey") % PAGES).alias("page_id"),
        F.col("o_orderkey").alias("post_id"),
        F.col("o_orderpriority").alias("post_content"),
        F.col("o_orderdate").alias("date_time"),
    )


def item_comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % PAGES).alias("page_id"),
        F.col("l_orderkey").alias("post_id"),
        F.col("l_linenumber").cast("bigint").alias("comment_id"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")).alias("comment_content"),
    )


def talk_posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("turn = 0").select(
        F.lit(0).cast("bigint").alias("page_id"), F.col("conv_id").alias("post_id"), F.col("text").alias("post_content")
    )


def talk_comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("turn > 0").select(
        F.lit(0).cast("bigint").alias("page_id"),
        F.col("conv_id").alias("post_id"),
        F.col("turn").alias("comment_id"),
        F.col("text").alias("comment_content"),
    )


def nested_talks(spark: SparkSession, d: str) -> DataFrame:
    nested = R.nest_comments(talk_posts(spark, d), talk_comments(spark, d))
    return nested.select(F.col("post_id").alias("doc_id"), "part", F.col("post_content").alias("status"), "comments")


def flat_comments(comments: str = "comments") -> F.Column:
    """Comments of a record as one string, so results can be compared value by value."""
    return F.array_join(F.transform(comments, lambda c: F.concat(c["comment_id"].cast("string"), F.lit(":"), c["text"])), "|")


POSTS = """posts AS (SELECT o_orderkey % 20 AS page_id, o_orderkey AS post_id, o_orderpriority AS post_content,
  o_orderdate AS date_time FROM orders)"""
COMMENTS = """comments AS (SELECT l_orderkey % 20 AS page_id, l_orderkey AS post_id, CAST(l_linenumber AS BIGINT) AS comment_id,
  concat_ws(' ', l_returnflag, l_linestatus, CAST(l_partkey AS VARCHAR)) AS comment_content FROM lineitem)"""
DAY = "strftime(date_time, '%Y-%m-%d')"
WANTED_PAGES = [3, 7, 11]
FROM, TO = "1996-01-01", "1997-12-31"


@query(
    "rel_01_post_comment_join",
    f"""WITH {POSTS}, {COMMENTS}
    SELECT p.page_id, p.post_id, p.post_content, c.comment_id, c.comment_content
    FROM posts p LEFT JOIN comments c ON p.page_id = c.page_id AND p.post_id = c.post_id""",
)
def rel_01(spark: SparkSession, d: str) -> DataFrame:
    joined = R.post_comments(order_posts(spark, d), item_comments(spark, d))
    return joined.select("page_id", "post_id", "post_content", "comment_id", "comment_content")


@query(
    "rel_02_pages_filter",
    f"WITH {POSTS} SELECT page_id, post_id, post_content, {DAY} AS day FROM posts WHERE page_id IN (3, 7, 11)",
)
def rel_02(spark: SparkSession, d: str) -> DataFrame:
    posts = R.posts_of_pages(order_posts(spark, d), WANTED_PAGES)
    return posts.select("page_id", "post_id", "post_content", F.date_format("date_time", "yyyy-MM-dd").alias("day"))


@query(
    "rel_03_date_range",
    f"""WITH {POSTS} SELECT page_id, post_id, {DAY} AS day FROM posts
    WHERE date_time BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'""",
)
def rel_03(spark: SparkSession, d: str) -> DataFrame:
    posts = R.posts_of_pages(order_posts(spark, d), range(PAGES), FROM, TO)
    return posts.select("page_id", "post_id", F.date_format("date_time", "yyyy-MM-dd").alias("day"))


@query(
    "rel_04_ordered_slice",
    f"""WITH {POSTS}, {COMMENTS}
    SELECT row_number() OVER (ORDER BY p.post_id, c.comment_id NULLS FIRST) AS rank, p.page_id, p.post_id, c.comment_id
    FROM posts p LEFT JOIN comments c ON p.page_id = c.page_id AND p.post_id = c.post_id""",
)
def rel_04(spark: SparkSession, d: str) -> DataFrame:
    from chatterloom.operators.scale import global_rank

    joined = R.post_comments(order_posts(spark, d), item_comments(spark, d)).select("page_id", "post_id", "comment_id")
    return global_rank(joined, [F.col("post_id"), F.col("comment_id")])


@query(
    "rel_05_nest_comments",
    f"""WITH {POSTS}, {COMMENTS}
    SELECT p.page_id, p.post_id, p.post_content,
      row_number() OVER (PARTITION BY p.page_id ORDER BY p.post_id) - 1 AS index,
      coalesce(n.n_comments, 0) AS n_comments, coalesce(n.comments, '') AS comments
    FROM posts p LEFT JOIN (SELECT page_id, post_id, count(*) AS n_comments,
      string_agg(comment_id || ':' || comment_content, '|' ORDER BY comment_id, comment_content) AS comments
      FROM comments GROUP BY page_id, post_id) n ON p.page_id = n.page_id AND p.post_id = n.post_id""",
)
def rel_05(spark: SparkSession, d: str) -> DataFrame:
    posts = R.number_posts(order_posts(spark, d))
    nested = R.nest_comments(posts, item_comments(spark, d))
    return nested.select(
        "page_id", "post_id", "post_content", "index",
        F.size("comments").cast("bigint").alias("n_comments"), flat_comments().alias("comments"),
    )


@query(
    "rel_05_nest_talks",
    """SELECT p.conv_id AS doc_id, p.text AS status, coalesce(c.comments, '') AS comments
    FROM conversations p LEFT JOIN (SELECT conv_id, string_agg(turn || ':' || text, '|' ORDER BY turn) AS comments
      FROM conversations WHERE turn > 0 GROUP BY conv_id) c ON p.conv_id = c.conv_id WHERE p.turn = 0""",
)
def rel_05_talks(spark: SparkSession, d: str) -> DataFrame:
    return nested_talks(spark, d).select("doc_id", "status", flat_comments().alias("comments"))


@query(
    "rel_06_dated_content",
    f"""WITH {POSTS} SELECT page_id, post_id,
      strftime(date_time, '%m/%d/%Y') || chr(10) || post_content AS content FROM posts""",
)
def rel_06(spark: SparkSession, d: str) -> DataFrame:
    return order_posts(spark, d).select(
        "page_id", "post_id", R.dated(F.col("post_content"), F.col("date_time")).alias("content")
    )


# Line items with ids as they may come from outside: sparse 64-bit numbers, repeats, and null for one line number.
ODD_COMMENTS = """comments AS (SELECT l_orderkey % 20 AS page_id, l_orderkey AS post_id,
  CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN l_partkey % 2 ELSE CAST(l_partkey AS BIGINT) * 1000003 END AS comment_id,
  concat_ws(' ', l_returnflag, l_linestatus, CAST(l_partkey AS VARCHAR)) AS comment_content FROM lineitem)"""


def odd_comments(spark: SparkSession, d: str) -> DataFrame:
    line, item = F.col("l_linenumber"), F.col("l_partkey").cast("bigint")
    odd = F.when(line == 3, F.lit(None)).when(line == 4, item % 2).otherwise(item * 1000003).cast("bigint")
    text = F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % PAGES).alias("page_id"), F.col("l_orderkey").alias("post_id"), odd.alias("comment_id"), text.alias("comment_content")
    )


@query(
    "rel_01_odd_ids",
    f"""WITH {POSTS}, {ODD_COMMENTS}
    SELECT p.page_id, p.post_id, c.comment_id, c.comment_content
    FROM posts p LEFT JOIN comments c ON p.page_id = c.page_id AND p.post_id = c.post_id""",
)
def rel_01_odd(spark: SparkSession, d: str) -> DataFrame:
    joined = R.post_comments(order_posts(spark, d), odd_comments(spark, d))
    return joined.select("page_id", "post_id", "comment_id", "comment_content")


@query(
    "rel_05_odd_ids",
    f"""WITH {POSTS}, {ODD_COMMENTS}
    SELECT p.page_id, p.post_id, coalesce(n.n_comments, 0) AS n_comments, coalesce(n.comments, '') AS comments
    FROM posts p LEFT JOIN (SELECT page_id, post_id, count(*) AS n_comments,
      string_agg(coalesce(CAST(comment_id AS VARCHAR), '-') || ':' || comment_content, '|' ORDER BY comment_id NULLS FIRST, comment_content) AS comments
      FROM comments GROUP BY page_id, post_id) n ON p.page_id = n.page_id AND p.post_id = n.post_id""",
)
def rel_05_odd(spark: SparkSession, d: str) -> DataFrame:
    nested = R.nest_comments(order_posts(spark, d), odd_comments(spark, d))
    shown = F.transform("comments", lambda c: F.concat(F.coalesce(c["comment_id"].cast("string"), F.lit("-")), F.lit(":"), c["text"]))
    return nested.select("page_id", "post_id", F.size("comments").cast("bigint").alias("n_comments"), F.array_join(shown, "|").alias("comments"))


@query(
    "rel_11_odd_ids",
    f"""WITH {POSTS}, {ODD_COMMENTS}
    SELECT post_id AS doc_id, 'status' AS kind, NULL::BIGINT AS comment_id, post_content AS text FROM posts
    UNION ALL SELECT c.post_id, 'comment', c.comment_id, c.comment_content FROM comments c JOIN posts p USING (page_id, post_id)""",
)
def rel_11_odd(spark: SparkSession, d: str) -> DataFrame:
    """Posts in parts of about three comments: each post text once, each comment once."""
    nested = R.nest_comments(order_posts(spark, d), odd_comments(spark, d), size=3)
    return R.unnest_texts(nested.select(F.col("post_id").alias("doc_id"), "part", F.col("post_content").alias("status"), "comments"))


@query("rel_07_list_pages", "SELECT page_id, url AS website FROM pages")
def rel_07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.col("url").alias("website"))


@query("rel_08_page_by_id", "SELECT page_id, url AS website, html AS about FROM pages WHERE page_id = 17")
def rel_08(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("website"), F.col("html").alias("about"))
    return pages.where(F.col("page_id") == 17)


@query(
    "rel_09_comments_of_page",
    f"WITH {COMMENTS} SELECT post_id, comment_id, comment_content FROM comments WHERE page_id = 7",
)
def rel_09(spark: SparkSession, d: str) -> DataFrame:
    return item_comments(spark, d).where(F.col("page_id") == 7).select("post_id", "comment_id", "comment_content")


# A topic table derived from the talks themselves: topic = length of the post modulo 3.
TALK_TOPICS = """talk_topics AS (SELECT topic_id, doc_id,
  row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, doc_id) AS rank
  FROM (SELECT length(text) % 3 + 1 AS topic_id, conv_id AS doc_id, length(text) AS weight FROM conversations WHERE turn = 0))"""


@query(
    "rel_10_documents_of_topic",
    f"""WITH {TALK_TOPICS}, nested AS (SELECT p.conv_id AS doc_id, p.text AS status,
      coalesce((SELECT string_agg(c.turn || ':' || c.text, '|' ORDER BY c.turn) FROM conversations c
        WHERE c.conv_id = p.conv_id AND c.turn > 0), '') AS comments FROM conversations p WHERE p.turn = 0)
    SELECT t.rank, n.doc_id, n.status, n.comments FROM nested n JOIN talk_topics t ON n.doc_id = t.doc_id
    WHERE t.topic_id = 2""",
)
def rel_10(spark: SparkSession, d: str) -> DataFrame:
    from chatterloom.operators.scale import global_rank

    weights = talk_posts(spark, d).select(
        (F.length("post_content") % 3 + 1).cast("bigint").alias("topic_id"),
        F.col("post_id").alias("doc_id"),
        F.length("post_content").alias("weight"),
    )
    ranked = global_rank(weights, [F.desc("weight"), F.col("doc_id")], ["topic_id"])
    found = R.documents_of_topic(ranked, nested_talks(spark, d), 2)
    return found.select("rank", "doc_id", "status", flat_comments().alias("comments"))


@query(
    "rel_11_unnest_texts",
    """SELECT conv_id AS doc_id, CASE WHEN turn = 0 THEN 'status' ELSE 'comment' END AS kind,
      CASE WHEN turn > 0 THEN turn END AS comment_id, text FROM conversations""",
)
def rel_11(spark: SparkSession, d: str) -> DataFrame:
    return R.unnest_texts(nested_talks(spark, d))
