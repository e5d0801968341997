"""Sources, sinks and the stream: data derived from the tables is written, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.operators import directories, lexer, ngram, relational
from chatterloom.operators import sentiment as S
from chatterloom.operators.corpus import line_differences
from chatterloom.operators.scale import cut_lineage, global_rank
from chatterloom.operators.tokenize import token_line
from chatterloom.operators.topics import documents_per_topic, top_documents
from chatterloom.plans import lm, sen
from chatterloom.plans.grf import TRADE, trade
from chatterloom.plans.registry import query, table
from chatterloom.plans.rel import FROM, POSTS, TO, order_posts
from chatterloom.plans.tok import TAGGED_TOKENS, lexicon_of, tagged_tokens, word_frequencies
from chatterloom.plans.txt import documents, documents_in_order
from chatterloom.session import ensure_checkpoint_dir
from chatterloom.sinks import store
from chatterloom.sinks import text as sinks
from chatterloom.sources import files, graphs
from chatterloom.streaming.scoring import score_stream, stream_texts


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint area."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def written(df: DataFrame, value: F.Column, *order: str) -> str:
    """Text files holding ``value`` line by line in the given order; returns their folder."""
    path = scratch(df.sparkSession)
    (df.orderBy(*order) if order else df).select(value.alias("value")).write.text(path)
    return path


# --- sources ------------------------------------------------------------------------------------------


def _pairs_query(name: str, key: str, value: str, no_tab: str) -> None:
    """A lookup file in which keys repeat and some lines lack the tab."""

    @query(
        name,
        f"""SELECT {key} AS key, arg_max({value}, p_partkey) AS value FROM part WHERE NOT ({no_tab}) GROUP BY {key}""",
    )
    def run(spark: SparkSession, d: str) -> DataFrame:
        part = table(spark, d, "part")
        line = F.when(F.expr(no_tab), F.col(key)).otherwise(F.concat(F.col(key), F.lit("\t"), F.expr(value)))
        return files.read_pairs(spark, written(part, line, "p_partkey"))


_pairs_query("src_01_spelling_pairs", "p_name", "p_type", "p_size = 1")
_pairs_query("src_02_emoticon_pairs", "p_type", "' ' || p_name || ' '", "p_size = 2")
_pairs_query("src_03_emoji_pairs", "p_brand", "p_type || ' '", "p_size = 3")
_pairs_query("src_04_letter_pairs", "p_brand", "p_name", "p_size = 4")


def _list_query(name: str, source: str, column: str) -> None:
    @query(name, f"SELECT DISTINCT trim({column}) AS word FROM {source} WHERE trim({column}) <> ''")
    def run(spark: SparkSession, d: str) -> DataFrame:
        lines = F.concat(F.lit(" "), F.col(column), F.lit(" "))
        return files.read_word_list(spark, written(table(spark, d, source), lines))


_list_query("src_05_stop_word_list", "part", "p_name")
_list_query("src_06_negation_list", "part", "p_type")
_list_query("src_07_opinion_word_list", "customer", "c_mktsegment")

ONE_LINE = "regexp_replace(text, '\\s+', ' ', 'g')"


@query(
    "src_08_training_text",
    f"SELECT quality::DOUBLE AS label, {ONE_LINE} AS text FROM documents JOIN labels USING (doc_id) WHERE toxic = 0",
)
def src_08(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).join(table(spark, d, "labels"), "doc_id")
    label = F.when(F.col("toxic") == 0, F.col("quality").cast("string")).otherwise("unknown")
    return files.read_training_text(spark, written(rows, F.concat_ws("\t", label, F.regexp_replace("text", r"\s+", " "))))


@query(
    "src_09_sentiment_lexicon",
    f"""WITH {sen.SYNSETS} SELECT pos, w || '-' || r AS id, pos_score, neg_score, synset_terms, w AS gloss FROM synsets WHERE r <> 3""",
)
def src_09(spark: SparkSession, d: str) -> DataFrame:
    rows = sen.synsets(spark, d)
    score = F.when(F.col("id").endswith("-3"), "?").otherwise(F.col("pos_score").cast("string"))
    line = F.concat_ws("\t", "pos", "id", score, F.col("neg_score").cast("string"), "synset_terms", "gloss")
    return files.read_sentiment_lexicon(spark, written(rows, line)).drop("line")


@query("src_10_lexicon_xml", "SELECT p_name AS content, CAST(count(*) AS VARCHAR) AS msd FROM part GROUP BY p_name")
def src_10(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    path = scratch(spark)
    sinks.write_lexicon_xml(sinks.lexicon_records(counts, F.col("p_name"), F.col("n")), path)
    return files.read_lexicon_xml(spark, path)


LINES = """lines AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


@query("src_11_corpora", f"WITH {LINES} SELECT row_number() OVER (ORDER BY doc_id, i) AS rank, line AS token FROM lines")
def src_11(spark: SparkSession, d: str) -> DataFrame:
    tokens = files.read_corpora(spark, written(document_lines(spark, d), F.col("line"), "doc_id", "i"))
    return global_rank(tokens, [F.col("file"), F.col("pos")]).select("rank", "token")


def _one_file(spark: SparkSession, head: DataFrame, body: DataFrame) -> str:
    """A head line and ordered lines in one file: at most one line per pair of nations."""
    path = scratch(spark)
    rows = head.select(F.lit(-1).cast("bigint").alias("a"), F.lit(-1).cast("bigint").alias("b"), "value").unionByName(body)
    rows.coalesce(1).sortWithinPartitions("a", "b").select("value").write.text(path)
    return path


def _nation_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").agg(F.count("*").cast("string").alias("value"))


@query("src_12_edge_list", f"WITH {TRADE} SELECT DISTINCT src, dst FROM trade")
def src_12(spark: SparkSession, d: str) -> DataFrame:
    pairs = trade(spark, d).distinct()
    body = pairs.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    return graphs.read_edges(spark, _one_file(spark, _nation_count(spark, d), body))[1]


@query("src_13_weighted_edge_list", f"WITH {TRADE} SELECT src, dst, count(*)::DOUBLE AS weight FROM trade GROUP BY src, dst")
def src_13(spark: SparkSession, d: str) -> DataFrame:
    counts = trade(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"))
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("src", "dst", "n")])
    body = counts.select(F.col("src").alias("a"), F.col("dst").alias("b"), line.alias("value"))
    return graphs.read_weighted_edges(spark, _one_file(spark, _nation_count(spark, d), body))[1]


@query(
    "src_14_adjacency_matrix",
    f"WITH {TRADE} SELECT src, dst FROM trade GROUP BY src, dst HAVING count(*) % 3 <> 0",
)
def src_14(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"))
    cells = trade(spark, d).groupBy("src", "dst").agg((F.count("*") % 3 != 0).cast("int").alias("cell"))
    lists = cells.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "cell"))).alias("m"))
    n = nations.count()
    row = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)).cast("string"))
    body = nations.join(lists, "src", "left").select(F.col("src").alias("a"), F.col("src").alias("b"), F.array_join(row, " ").alias("value"))
    return graphs.read_matrix(spark, _one_file(spark, _nation_count(spark, d), body))[1]


@query(
    "src_15_table_slice",
    f"""WITH {POSTS} SELECT page_id, post_id, post_content FROM posts WHERE page_id = 7
    AND date_time BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'""",
)
def src_15(spark: SparkSession, d: str) -> DataFrame:
    return relational.posts_of_pages(order_posts(spark, d), [7], FROM, TO).select("page_id", "post_id", "post_content")


@query("src_16_texts_by_extension", f"WITH {LINES} SELECT line AS text, count(*) AS n FROM lines GROUP BY line")
def src_16(spark: SparkSession, d: str) -> DataFrame:
    texts = files.read_texts(spark, written(document_lines(spark, d), F.col("line")), ".txt")
    return texts.groupBy("text").agg(F.count("*").alias("n"))


# --- sinks ----------------------------------------------------------------------------------------------


def _page_rows(spark: SparkSession, d: str, post: bool) -> DataFrame:
    rows = table(spark, d, "conversations").where("turn = 0" if post else "turn > 0")
    keys = [(F.col("conv_id") % 20).alias("page_id"), F.col("conv_id").alias("post_id")]
    if post:
        return rows.select(*keys, F.col("text").alias("post_content"))
    return rows.select(*keys, F.col("turn").alias("comment_id"), F.col("text").alias("comment_content"))


def _replaced(rows: DataFrame, content: str) -> DataFrame:
    """New rows for pages 3 and 7; page 11 is listed too but gets none."""
    return rows.where("page_id IN (3, 7)").withColumn(content, F.concat(F.lit("é "), content))


def _replaced_sql(columns: str, content: str, which: str) -> str:
    return f"""SELECT conv_id % 20 AS page_id, conv_id AS post_id, {columns}
      CASE WHEN conv_id % 20 IN (3, 7) THEN 'é ' || text ELSE text END AS {content} FROM conversations WHERE {which} AND conv_id % 20 <> 11"""


def _read_rows(spark: SparkSession, path: str) -> DataFrame:
    from chatterloom.sources.tables import read_pages_table

    return read_pages_table(spark, path).withColumn("page_id", F.col("page_id").cast("bigint"))


@query("snk_01_save_posts", _replaced_sql("", "post_content", "turn = 0"))
def snk_01(spark: SparkSession, d: str) -> DataFrame:
    rows, path = _page_rows(spark, d, post=True), scratch(spark)
    store.save_posts(rows, path, range(20))
    store.save_posts(_replaced(rows, "post_content"), path, [3, 7, 11])
    return _read_rows(spark, path)


@query("snk_02_save_comments", _replaced_sql("turn AS comment_id,", "comment_content", "turn > 0"))
def snk_02(spark: SparkSession, d: str) -> DataFrame:
    rows, path = _page_rows(spark, d, post=False), scratch(spark)
    store.save_comments(rows, path, range(20))
    store.save_comments(_replaced(rows, "comment_content"), path, [3, 7, 11])
    return _read_rows(spark, path)


@query(
    "snk_03_save_batch",
    """SELECT conv_id % 20 AS page_id, conv_id AS post_id, turn, text FROM conversations""",
)
def snk_03(spark: SparkSession, d: str) -> DataFrame:
    posts_path, comments_path = scratch(spark), scratch(spark)
    store.save_batch(_page_rows(spark, d, True), _page_rows(spark, d, False), posts_path, comments_path, range(20))
    posts = _read_rows(spark, posts_path).select("page_id", "post_id", F.lit(0).cast("bigint").alias("turn"), F.col("post_content").alias("text"))
    comments = _read_rows(spark, comments_path)
    return posts.union(comments.select("page_id", "post_id", F.col("comment_id").alias("turn"), F.col("comment_content").alias("text")))


@query(
    "snk_03_committed_batch",
    f"""SELECT page_id, post_id, 0 AS turn, post_content AS text FROM ({_replaced_sql("", "post_content", "turn = 0")})
    UNION ALL SELECT page_id, post_id, turn, comment_content FROM ({_replaced_sql("turn,", "comment_content", "turn > 0")})""",
)
def snk_03_committed(spark: SparkSession, d: str) -> DataFrame:
    path, posts, comments = scratch(spark), _page_rows(spark, d, True), _page_rows(spark, d, False)
    store.commit_batch(posts, comments, path, range(20))
    store.commit_batch(_replaced(posts, "post_content"), _replaced(comments, "comment_content"), path, [3, 7, 11])
    # What a killed write leaves behind is not read.
    posts.write.partitionBy("page_id").parquet(f"{path}/posts/batch=unfinished")
    saved = store.read_committed(spark, path, "posts", "post_id bigint, post_content string")
    answers = store.read_committed(spark, path, "comments", "post_id bigint, comment_id bigint, comment_content string")
    return saved.select("page_id", "post_id", F.lit(0).cast("bigint").alias("turn"), F.col("post_content").alias("text")).union(
        answers.select("page_id", "post_id", "comment_id", "comment_content")
    )


@query(
    "snk_04_save_profiles",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url || '#2' ELSE url END AS website FROM pages
    UNION ALL SELECT page_id + 1000000, url || '#2' FROM pages WHERE page_id % 5 = 0""",
)
def snk_04(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("website"))
    path = scratch(spark)
    store.save_profiles(pages.withColumn("ord", F.lit(0)), path, "ord")
    changed = pages.where("page_id % 5 = 0")
    changed = changed.union(changed.withColumn("page_id", F.col("page_id") + 1_000_000))
    batch = changed.select("page_id", "website", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"))
    store.save_profiles(batch.withColumn("website", F.concat("website", F.lit("#"), F.col("ord").cast("string"))), path, "ord")
    return store.read_profiles(spark, path)


@query(
    "snk_05_append_feedback",
    """SELECT 'doc ' || doc_id AS feedback_content, quality AS feedback_label FROM labels
    UNION ALL SELECT 'doc ' || doc_id, toxic FROM labels""",
)
def snk_05(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    content = F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("feedback_content")
    path = scratch(spark)
    for column in ("quality", "toxic"):
        store.append_feedback(labels.select(content, F.col(column).alias("feedback_label")), path)
    return spark.read.parquet(path)


@query(
    "snk_06_weak_label_file",
    """SELECT CASE WHEN quality + toxic = 0 THEN 0 ELSE 1 END::DOUBLE AS label, 'doc ' || doc_id AS text FROM labels WHERE quality + toxic <> 1""",
)
def snk_06(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    rows = labels.select((F.col("quality") + F.col("toxic") - 1).alias("label"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("text"))
    path = scratch(spark)
    sinks.write_tsv(S.weak_labels(rows), path, "label", "text")
    return files.read_training_text(spark, path)


@query("snk_07_unigram_file", f"WITH {lm.TOKENS} SELECT token AS key, CAST(freq AS VARCHAR) AS value FROM unigram")
def snk_07(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_unigrams(lm.unigrams(spark, d), path)
    return files.read_pairs(spark, path)


@query("snk_07_unigram_totals", f"WITH {lm.TOKENS} SELECT CAST(sum(freq) AS BIGINT) AS n_tokens, count(*) AS n_types FROM unigram")
def snk_07_totals(spark: SparkSession, d: str) -> DataFrame:
    return sinks.unigram_totals(cut_lineage(lm.unigrams(spark, d)))


@query(
    "snk_08_bigram_file",
    f"WITH {lm.TOKENS}, {lm.BIGRAMS} SELECT first || chr(9) || second || chr(9) || freq AS value FROM bigram",
)
def snk_08(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_bigrams(lm.bigrams(spark, d), path)
    return files.read_lines(spark, path).select("value")


@query(
    "snk_09_bigram_xml",
    f"""WITH {lm.TOKENS}, {lm.BIGRAMS} SELECT first || ',' || second AS content, CAST(freq AS VARCHAR) AS msd FROM bigram""",
)
def snk_09(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_lexicon_xml(sinks.bigram_records(lm.bigrams(spark, d)), path)
    return files.read_lexicon_xml(spark, path)


@query("snk_09_unigram_xml", f"WITH {lm.TOKENS} SELECT token AS content, CAST(freq AS VARCHAR) AS msd FROM unigram")
def snk_09_unigrams(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_lexicon_xml(sinks.unigram_records(lm.unigrams(spark, d)), path)
    return files.read_lexicon_xml(spark, path)


@query(
    "snk_10_conditional_xml",
    f"""WITH {lm.TOKENS}, {lm.BIGRAMS}, {lm.COND} SELECT second || '|' || first AS content, printf('%.3f', prob) AS msd FROM cond""",
)
def snk_10_xml(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    probabilities = ngram.conditional_probability(lm.bigrams(spark, d), lm.unigrams(spark, d))
    sinks.write_lexicon_xml(sinks.probability_records(probabilities), path)
    return files.read_lexicon_xml(spark, path)


@query(
    "snk_10_conditional_lines",
    f"""WITH {lm.TOKENS}, {lm.BIGRAMS}, {lm.COND}
    SELECT '(' || second || '|' || first || ')' || chr(9) || printf('%.3f', prob) AS value FROM cond""",
)
def snk_10(spark: SparkSession, d: str) -> DataFrame:
    lines = sinks.conditional_lines(ngram.conditional_probability(lm.bigrams(spark, d), lm.unigrams(spark, d)))
    return files.read_lines(spark, written(lines, F.col("value"))).select("value")


@query(
    "snk_11_vocabulary_file",
    f"WITH {lm.TOKENS} SELECT row_number() OVER (ORDER BY token) AS rank, token FROM unigram WHERE freq >= 2",
)
def snk_11(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_words(ngram.vocabulary(lm.unigrams(spark, d), 2), "token", path)
    return global_rank(files.read_corpora(spark, path), [F.col("file"), F.col("pos")]).select("rank", "token")


def _token_format_query(name: str, form: str, value: str) -> None:
    @query(name, f"WITH {TAGGED_TOKENS} SELECT row_number() OVER (ORDER BY doc_id, pos) AS rank, {value} AS value FROM tokens")
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = scratch(spark)
        sinks.write_token_lines(tagged_tokens(spark, d, documents_in_order), path, ["doc_id", "pos"], form)
        return files.read_corpora(spark, path, rank="rank").select("rank", F.col("token").alias("value"))


_token_format_query("snk_12_plain_tokens", "plain", "token")
_token_format_query("snk_13_two_column_tokens", "2cols", "token || chr(9) || rule")
_token_format_query("snk_14_xml_tokens", "xml", "'<w>' || replace(replace(replace(token, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</w>'")


@query("snk_15_corpus_xml")
def snk_15(spark: SparkSession, d: str) -> DataFrame:
    lines = lexer.lex_lines(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    path = scratch(spark)
    sinks.write_corpus_xml(sinks.sentence_records(lines, ["doc_id", "line"], ["pos"], listed="tokens"), path, ["doc_id", "line"], placed=True)
    schema = "w array<struct<_VALUE:string,_t:string>>, p string"
    words = spark.read.format("xml").option("rowTag", "s").schema(schema).load(path).select(F.explode("w").alias("w"))
    return words.groupBy(F.col("w._t").alias("rule")).agg(F.count("*").alias("n"))


@query(
    "snk_15_tagged_xml",
    f"""WITH {TAGGED_TOKENS} SELECT row_number() OVER (ORDER BY doc_id) AS rank, string_agg(token || chr(9) || rule, chr(10) ORDER BY pos) AS words
    FROM tokens GROUP BY doc_id""",
)
def snk_15_tagged(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence as it was written, in order: one text is one sentence here."""
    path = scratch(spark)
    sinks.write_corpus_xml(sinks.sentence_records(tagged_tokens(spark, d, documents_in_order), ["doc_id"], ["pos"]), path, ["doc_id"])
    schema = "w array<struct<_VALUE:string,_t:string>>, p string"
    read = spark.read.format("xml").option("rowTag", "s").schema(schema).load(path)
    lines = F.array_join(F.transform("w", lambda w: F.concat_ws("\t", w["_VALUE"], w["_t"])), "\n")
    placed = read.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"), lines.alias("value"))
    numbered = files.number_lines(placed.withColumn("block", F.shiftright("row", 33)), rank="rank")
    return numbered.select("rank", F.col("value").alias("words"))


@query(
    "snk_16_tokenised_text",
    f"""WITH {TAGGED_TOKENS} SELECT row_number() OVER (ORDER BY doc_id) AS rank,
      string_agg(replace(token, ' ', '_'), ' ' ORDER BY pos) AS text FROM tokens GROUP BY doc_id""",
)
def snk_16(spark: SparkSession, d: str) -> DataFrame:
    lines = token_line(tagged_tokens(spark, d, documents_in_order).withColumn("part", F.lit(0)), "doc_id")
    path = scratch(spark)
    sinks.write_tokenised(lines, path, "doc_id")
    return files.read_texts(spark, path, rank="rank").select("rank", "text")


@query(
    "snk_17_topic_lines",
    """WITH ranked AS (SELECT topic_id, doc_id, weight, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, doc_id) AS rank FROM (
      SELECT doc_id, n_chars % 3 + 1 AS topic_id, (n_chars // 64)::DOUBLE AS weight FROM documents)),
    kept AS (SELECT * FROM ranked WHERE rank <= (SELECT count(*) FROM documents) // 3 + 3),
    lines AS (SELECT topic_id, rank, doc_id || ':' || chr(9) || CAST(weight AS VARCHAR) AS value FROM kept
      UNION ALL SELECT DISTINCT topic_id, 0, 'TOPIC: ' || topic_id FROM kept)
    SELECT row_number() OVER (ORDER BY topic_id, rank) AS rank, value FROM lines""",
)
def snk_17(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    weights = docs.select((F.col("n_chars") % 3 + 1).alias("topic_id"), "doc_id", F.floor(F.col("n_chars") / 64).cast("double").alias("weight"))
    top = top_documents(weights, "doc_id", documents_per_topic(docs.count(), 3))
    path = scratch(spark)
    sinks.write_topic_lines(top, "doc_id", path)
    return global_rank(files.read_corpora(spark, path), [F.col("file"), F.col("pos")]).select("rank", F.col("token").alias("value"))


@query(
    "snk_18_chart_json",
    """SELECT '[["Label", "Percent"],' || string_agg('["' || source || '", ' || percent || ']', ',' ORDER BY source) || ']' AS json FROM (
      SELECT source, CAST(round(CAST(count(*) * 100 AS DECIMAL(28, 6)) / (SELECT count(*) FROM documents), 0) AS INT) AS percent
      FROM documents GROUP BY source)""",
)
def snk_18(spark: SparkSession, d: str) -> DataFrame:
    return sinks.chart_json(S.label_share(table(spark, d, "documents"), "source"))


@query(
    "snk_19_difference_report",
    f"""WITH texts AS (SELECT doc_id + 1 AS line_no, {ONE_LINE} AS a FROM documents),
    diff AS (SELECT line_no, 'Line ' || line_no || ': ' || a || ' # ' || replace(a, 'the ', 'The ') AS value FROM texts
      WHERE a <> replace(a, 'the ', 'The ')),
    report AS (SELECT -1 AS line_no, '# of differences = ' || count(*) AS value FROM diff UNION ALL SELECT 0, '' UNION ALL SELECT * FROM diff)
    SELECT row_number() OVER (ORDER BY line_no) AS rank, value FROM report""",
)
def snk_19(spark: SparkSession, d: str) -> DataFrame:
    left = documents(spark, d).select((F.col("doc_id") + 1).alias("line_no"), F.regexp_replace("text", r"\s+", " ").alias("line"))
    right = left.select("line_no", F.replace("line", F.lit("the "), F.lit("The ")).alias("line"))
    path = scratch(spark)
    sinks.write_report(line_differences(left, right), path)
    return global_rank(files.read_corpora(spark, path), [F.col("file"), F.col("pos")]).select("rank", F.col("token").alias("value"))


# --- stream -----------------------------------------------------------------------------------------------

TALKS = "texts AS (SELECT conv_id || '/' || turn AS text_id, lower(text) AS text FROM conversations)"


def _streamed(spark: SparkSession, d: str, score) -> DataFrame:
    source, output, checkpoint = (scratch(spark) for _ in range(3))
    texts = sen.talk_texts(spark, d)
    texts.repartition(4, "text_id").write.parquet(source)
    score_stream(stream_texts(spark, source, texts.schema, files_per_batch=2), score, output, checkpoint)
    return spark.read.parquet(output).drop("batch")


@query("str_01_stream_lexicon_scores", sen._scored_sql(TALKS))
def str_01_lexicon(spark: SparkSession, d: str) -> DataFrame:
    scores = cut_lineage(S.word_scores(S.term_scores(sen.synsets(spark, d))))
    negations = sen.word_list(spark, sen.NEGATIONS)
    return _streamed(spark, d, lambda batch: S.sentence_scores(batch.withColumn("text", F.lower("text")), "text_id", "text", scores, negations))


@query("str_01_stream_labels")
def str_01(spark: SparkSession, d: str) -> DataFrame:
    model, lookups = sen.classifier(spark, d), sen.lookups(spark, d)
    return _streamed(spark, d, lambda batch: S.analyse_texts(batch, "text_id", "text", model, lookups).select("text_id", "label"))




# --- folders --------------------------------------------------------------------------------------------------


def _converted(spark: SparkSession, d: str, line: F.Column, convert) -> DataFrame:
    output = scratch(spark)
    convert(spark, written(document_lines(spark, d), line), output, ".txt")
    return spark.read.text(output).groupBy("value").agg(F.count("*").alias("n"))


@query(
    "cor_02_untag_folder",
    f"""WITH {LINES}, tagged AS (SELECT regexp_replace(line, '(\\S+)', '\\1/N', 'g') AS t FROM lines),
    plain AS (SELECT array_to_string(list_transform(list_filter(regexp_split_to_array(t, '\\s+'),
      lambda p: NOT regexp_matches(p, '^/+$')), lambda p: string_split(p, '/')[1]), ' ') AS t FROM tagged),
    trimmed AS (SELECT regexp_replace(t, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS t FROM plain)
    SELECT replace(replace(replace(replace(replace(replace(t, '*E*', ''), '*T*', ''), '*E', ''), 'E*', ''), '*T', ''), 'T*', '') AS value,
      count(*) AS n FROM trimmed GROUP BY 1""",
)
def cor_02(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark, d, F.regexp_replace("line", r"(\S+)", "$1/N"), directories.untag_folder)


@query(
    "cor_03_raw_folder",
    f"""WITH {LINES}, tight AS (SELECT regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(line, '([.,!?])', ' \\1', 'g'),
      '_', ' '), '\\s+', ' ', 'g'), ' ([.,!?:)”])', '\\1', 'g'), '([(“]) ', '\\1', 'g') AS t FROM lines)
    SELECT array_to_string(list_transform(string_split(t, '"'), lambda x, i: CASE WHEN i % 2 = 0 THEN trim(x) ELSE x END), '"') AS value,
      count(*) AS n FROM tight GROUP BY 1""",
)
def cor_03_folder(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark, d, F.regexp_replace("line", "([.,!?])", " $1"), directories.raw_text_folder)


@query("tok_13_tokenize_folder")
def tok_13(spark: SparkSession, d: str) -> DataFrame:
    lexicon = cut_lineage(lexicon_of(word_frequencies(spark, d)))
    folder = written(document_lines(spark, d), F.col("line"), "doc_id", "i")
    return directories.tokenize_folder(spark, folder, scratch(spark), lexicon, lexicon)
