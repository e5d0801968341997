"""Sentiment queries: documents with labels train, conversations are scored."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.operators import sentiment as S
from chatterloom.operators.scale import cut_lineage
from chatterloom.plans.registry import query, table
from chatterloom.plans.rel import flat_comments, nested_talks, talk_comments
from chatterloom.plans.tok import lexicon_of, word_frequencies
from chatterloom.plans.txt import EMOJI, EMOTICONS, SPELLING, STOP_WORDS, documents, lookup, sql_list, stop_words

OPINION_WORDS = ["hand", "ention", "nten", "avec", "pour", "nicht", "auch", "eren", "was", "as"]
NEGATIONS = ["the", "de", "und", "que"]


def word_list(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def lookups(spark: SparkSession, d: str, tokenised: bool = True) -> S.Lookups:
    """All tables of the sentiment job; lexicon and frequencies come from the documents.

    They are counted here for jobs that find words with them. A job whose texts are blank separated (``tokenised=False``) never reads
    them: for it they stay a plan, and no text is counted.
    """
    frequencies = lexicon_of(word_frequencies(spark, d))
    if tokenised:
        frequencies = cut_lineage(frequencies)
    return S.Lookups(
        lookup(spark, EMOTICONS), lookup(spark, EMOJI), lookup(spark, SPELLING), stop_words(spark), word_list(spark, OPINION_WORDS),
        frequencies.select("word"), frequencies,
    )


def labelled(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents(spark, d).join(labels, "doc_id")


def classifier(spark: SparkSession, d: str) -> PipelineModel:
    return S.train_classifier(cut_lineage(labelled(spark, d)), stop_words(spark))


def talk_texts(spark: SparkSession, d: str) -> DataFrame:
    talks = table(spark, d, "conversations")
    return talks.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("text_id"), "text")


WORDS = """word_arrays AS (SELECT doc_id, regexp_split_to_array(lower(text), '\\s+') AS tokens FROM documents)"""


def word_arrays(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.split(F.lower("text"), r"\s+").alias("tokens"))


@query("sen_01_hashed_counts")
def sen_01(spark: SparkSession, d: str) -> DataFrame:
    return S.hashed_counts(word_arrays(spark, d)).select("doc_id", F.col("counts").cast("string").alias("counts"))


@query(
    "sen_02_inverse_document_frequency",
    f"""WITH {WORDS}, df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM word_arrays) GROUP BY term)
    SELECT term, df, round(CASE WHEN df >= 5 THEN ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) ELSE 0 END, 9) AS idf FROM df""",
)
def sen_02(spark: SparkSession, d: str) -> DataFrame:
    return S.inverse_document_frequency(word_arrays(spark, d), "doc_id").withColumn("idf", F.round("idf", 9))


@query("sen_03_training_fit")
def sen_03(spark: SparkSession, d: str) -> DataFrame:
    tokens = S.training_tokens(labelled(spark, d), stop_words(spark))
    scored = classifier(spark, d).transform(tokens)
    return scored.groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query(
    "sen_04_opinion_gate",
    f"""WITH {WORDS} SELECT doc_id, len(list_filter(tokens, lambda t: list_contains({sql_list(OPINION_WORDS)}, t))) > 0 AS gated_in
    FROM word_arrays""",
)
def sen_04(spark: SparkSession, d: str) -> DataFrame:
    return S.has_opinion(word_arrays(spark, d), "doc_id", "tokens", word_list(spark, OPINION_WORDS)).select("doc_id", "gated_in")


@query("sen_05_labels")
def sen_05(spark: SparkSession, d: str) -> DataFrame:
    return S.classify(talk_texts(spark, d), "text_id", "text", classifier(spark, d), lookups(spark, d, tokenised=False)).select("text_id", "label")


@query(
    "sen_06_score_type",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 WHEN c_acctbal < 0 THEN -1 ELSE 0 END AS type FROM customer",
)
def sen_06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", S.score_type(F.col("c_acctbal")).alias("type"))


def _flat_report(df: DataFrame) -> DataFrame:
    comments = F.array_join(
        F.transform("comments", lambda c: F.concat_ws(":", c["comment_id"].cast("string"), c["type"].cast("string"), c["text"])), "|"
    )
    return df.select("doc_id", "part", "sentiment_type", F.col("status.text").alias("status"), comments.alias("comments"))


@query("sen_07_report")
def sen_07(spark: SparkSession, d: str) -> DataFrame:
    return _flat_report(S.report(nested_talks(spark, d), classifier(spark, d), lookups(spark, d)))


@query("sen_08_weighted_report")
def sen_08(spark: SparkSession, d: str) -> DataFrame:
    return _flat_report(S.report(nested_talks(spark, d), classifier(spark, d), lookups(spark, d), clean=False, post_weight=1.5))


def talk_candidates(spark: SparkSession, d: str) -> DataFrame:
    return talk_comments(spark, d).select(
        F.concat_ws("/", F.col("post_id").cast("string"), F.col("comment_id").cast("string")).alias("text_id"),
        F.col("comment_content").alias("text"),
    )


@query(
    "sen_09_training_candidates",
    rf"""WITH lookups AS (SELECT
      map({sql_list([k for k, _ in EMOTICONS])}, {sql_list([v for _, v in EMOTICONS])}) AS e,
      map({sql_list([k for k, _ in EMOJI])}, {sql_list([v + ' ' for _, v in EMOJI])}) AS j,
      map({sql_list([k for k, _ in SPELLING])}, {sql_list([v for _, v in SPELLING])}) AS s),
    marked AS (SELECT conv_id || '/' || turn AS text_id, regexp_extract_all(lower(text), '\*\*\*|###|%%%|-->|--|(?s:.)') AS parts
      FROM conversations WHERE turn > 0),
    one AS (SELECT text_id, s, j, array_to_string(list_transform(parts, lambda p, i: CASE WHEN e[p] IS NOT NULL
      AND NOT regexp_matches(coalesce(right(parts[i - 1], 1), ''), '^\w$')
      AND NOT regexp_matches(coalesce(left(parts[i + 1], 1), ''), '^\w$') THEN e[p] ELSE p END), '') AS text FROM marked, lookups),
    two AS (SELECT text_id, s, array_to_string(list_transform(
      regexp_extract_all(text, ':nav|&amp;|➔|—|é|{EMOJI[-1][0]}|(?s:.)'), lambda p: coalesce(j[p], p)), '') AS text FROM one),
    three AS (SELECT text_id, array_to_string(list_transform(
      regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), lambda p: coalesce(s[lower(p)], p)), '') AS text FROM two),
    four AS (SELECT text_id, regexp_replace(regexp_replace(text, '[0-9]', ' ', 'g'),
      'https?:(?://|\\)+[\w:#@%/;$()~?+,\-.<=\\&]*', ' ', 'g') AS text FROM three)
    SELECT text_id, text FROM four WHERE length(text) > 7""",
)
def sen_09(spark: SparkSession, d: str) -> DataFrame:
    return S.training_candidates(talk_candidates(spark, d), "text_id", "text", lookups(spark, d, tokenised=False))


# A sentiment lexicon made from the words of the documents: three synsets per frequent word.
SYNSETS = """counted AS (SELECT w, count(*) AS freq FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS w FROM documents)
  WHERE length(w) > 1 GROUP BY w HAVING count(*) >= 20),
synsets AS (SELECT w, freq, r, freq * 10 + r AS line, ['n', 'a', 'r', 'v', 'x'][CAST((length(w) + r) % 5 + 1 AS INT)] AS pos,
  ((freq * r) % 9) / 8.0::DOUBLE AS pos_score, ((freq + length(w) * r) % 5) / 8.0::DOUBLE AS neg_score,
  w || '#' || r || ' ' || w || ' ' || left(w, 2) || '#2 ' || w || '#x' AS synset_terms FROM counted, (SELECT unnest([1, 2, 3]) AS r)),
ranked AS (SELECT w AS term, pos, r AS rank, pos_score - neg_score AS score, line, 0 AS spot FROM synsets
  UNION ALL SELECT w || '_' || left(w, 2), pos, 2, pos_score - neg_score, line, 1 FROM synsets),
last AS (SELECT term, pos, rank, arg_max(score, line * 10 + spot) AS score FROM ranked GROUP BY term, pos, rank),
term_scores AS (SELECT term, pos, sum(score / rank) / sum(1.0::DOUBLE / rank) AS score FROM last GROUP BY term, pos),
word_scores AS (SELECT term AS word, sum(score) AS score FROM term_scores WHERE pos IN ('n', 'a', 'r', 'v') GROUP BY term)"""


def synsets(spark: SparkSession, d: str) -> DataFrame:
    words = documents(spark, d).select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    counted = words.where(F.length("w") > 1).groupBy("w").agg(F.count("*").alias("freq")).where("freq >= 20")
    r = F.col("r")
    return counted.select("w", "freq", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("r")).select(
        (F.col("freq") * 10 + r).alias("line"),
        F.get(F.array(*map(F.lit, "narvx")), (F.length("w") + r) % 5).alias("pos"),
        F.concat_ws("-", "w", r.cast("string")).alias("id"),
        ((F.col("freq") * r) % 9 / 8.0).alias("pos_score"),
        ((F.col("freq") + F.length("w") * r) % 5 / 8.0).alias("neg_score"),
        F.concat("w", F.lit("#"), r.cast("string"), F.lit(" "), "w", F.lit(" "), F.substring("w", 1, 2), F.lit("#2 "), "w", F.lit("#x")).alias("synset_terms"),
        F.col("w").alias("gloss"),
    )


@query("sen_10_term_scores", f"WITH {SYNSETS} SELECT term, pos, round(score, 9) AS score FROM term_scores")
def sen_10(spark: SparkSession, d: str) -> DataFrame:
    return S.term_scores(synsets(spark, d)).withColumn("score", F.round("score", 9))


@query("sen_11_word_scores", f"WITH {SYNSETS} SELECT word, round(score, 9) AS score FROM word_scores")
def sen_11(spark: SparkSession, d: str) -> DataFrame:
    return S.word_scores(S.term_scores(synsets(spark, d))).withColumn("score", F.round("score", 9))


def _scored_sql(texts: str) -> str:
    return f"""WITH {SYNSETS}, cents AS (SELECT word, CAST(round(CAST(score AS DECIMAL(28, 12)), 2) * 100 AS BIGINT) AS c FROM word_scores),
    {texts}, rows AS (SELECT text_id, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS before FROM (
      SELECT text_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT text_id, string_split(text, ' ') AS w FROM texts))),
    signed AS (SELECT r.text_id, CASE WHEN list_contains({sql_list(NEGATIONS)}, r.before) THEN -c.c ELSE c.c END AS c
      FROM rows r JOIN cents c ON r.word = c.word WHERE NOT list_contains({sql_list(NEGATIONS)}, r.word) AND c.c <> 0),
    sums AS (SELECT text_id, sum(c) AS s, count(*) AS n FROM signed GROUP BY text_id)
    SELECT t.text_id, coalesce(sign(s) * ((2 * abs(s) + n) // (2 * n)) / 100.0, 0) AS score FROM texts t LEFT JOIN sums s ON t.text_id = s.text_id"""


@query("sen_12_sentence_scores", _scored_sql("texts AS (SELECT doc_id AS text_id, lower(text) AS text FROM documents)"))
def sen_12(spark: SparkSession, d: str) -> DataFrame:
    scores = cut_lineage(S.word_scores(S.term_scores(synsets(spark, d))))
    texts = documents(spark, d).select(F.col("doc_id").alias("text_id"), F.lower("text").alias("text"))
    return S.sentence_scores(texts, "text_id", "text", scores, word_list(spark, NEGATIONS))


@query("sen_13_lexicon_sentiment")
def sen_13(spark: SparkSession, d: str) -> DataFrame:
    scores = cut_lineage(S.word_scores(S.term_scores(synsets(spark, d))))
    lexicon = cut_lineage(lexicon_of(word_frequencies(spark, d)))
    texts = talk_texts(spark, d).withColumn("text", F.lower("text"))
    return S.lexicon_sentiment(texts, "text_id", "text", scores, word_list(spark, NEGATIONS), lexicon, lexicon)


@query("sen_14_weak_label_rows")
def sen_14(spark: SparkSession, d: str) -> DataFrame:
    scored = S.label_candidates(talk_candidates(spark, d), "text_id", "text", classifier(spark, d), lookups(spark, d))
    return S.weak_labels(scored)


@query("sen_15_opinion_word_list", f"WITH {SYNSETS} SELECT DISTINCT term || '#' || pos AS entry FROM term_scores")
def sen_15(spark: SparkSession, d: str) -> DataFrame:
    return S.opinion_word_list(S.term_scores(synsets(spark, d)))


@query(
    "sen_16_label_share",
    """SELECT quality + toxic AS label, CAST(round(CAST(count(*) * 100 AS DECIMAL(28, 6)) / (SELECT count(*) FROM labels), 0) AS INT) AS percent
    FROM labels GROUP BY quality + toxic""",
)
def sen_16(spark: SparkSession, d: str) -> DataFrame:
    return S.label_share(table(spark, d, "labels").select((F.col("quality") + F.col("toxic")).alias("label")))


@query("sen_17_classify_lines")
def sen_17(spark: SparkSession, d: str) -> DataFrame:
    lines = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("line_id"), "line")
    return S.classify(lines, "line_id", "line", classifier(spark, d), lookups(spark, d, tokenised=False)).select("line_id", "label")
