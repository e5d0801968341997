"""Corpus and word-list queries; tagged text is made from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.functions import text as X
from chatterloom.operators import corpus as C
from chatterloom.plans.registry import query, table
from chatterloom.plans.txt import documents, documents_in_order

TAGGED = "tagged AS (SELECT doc_id, regexp_replace(text, '(\\S+)', '\\1/N', 'g') AS text FROM documents)"
TRIM = "regexp_replace({}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def tagged_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.regexp_replace("text", r"(\S+)", "$1/N").alias("text"))


def token_rows(spark: SparkSession, d: str) -> DataFrame:
    return documents_in_order(spark, d).select("doc_id", F.posexplode(F.split("text", r"\s")).alias("pos", "token"))


@query(
    "cor_01_untag",
    f"""WITH {TAGGED}, plain AS (SELECT doc_id, array_to_string(list_transform(list_filter(
      regexp_split_to_array(text, '\\s+'), lambda p: NOT regexp_matches(p, '^/+$')), lambda p: string_split(p, '/')[1]), ' ') AS t
      FROM tagged)
    SELECT doc_id, replace(replace(replace(replace(replace(replace({TRIM.format('t')}, '*E*', ''), '*T*', ''), '*E', ''), 'E*', ''),
      '*T', ''), 'T*', '') AS text FROM plain""",
)
def cor_01(spark: SparkSession, d: str) -> DataFrame:
    return tagged_documents(spark, d).select("doc_id", C.untag(F.col("text")).alias("text"))


@query(
    "cor_03_raw_text",
    """WITH loose AS (SELECT doc_id, replace(regexp_replace(replace(text, ' la ', '_la '), '([.,!?:()"])', ' \\1 ', 'g'), '_', ' ') AS t
      FROM documents), tight AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'),
      ' ([.,!?:)”])', '\\1', 'g'), '([(“]) ', '\\1', 'g') AS t FROM loose)
    SELECT doc_id, array_to_string(list_transform(string_split(t, '"'),
      lambda x, i: CASE WHEN i % 2 = 0 THEN trim(x) ELSE x END), '"') AS text FROM tight""",
)
def cor_03(spark: SparkSession, d: str) -> DataFrame:
    loose = F.regexp_replace(F.replace("text", F.lit(" la "), F.lit("_la ")), r'([.,!?:()"])', " $1 ")
    return documents(spark, d).select("doc_id", C.raw_text(loose).alias("text"))


@query(
    "cor_04_tagged_words",
    f"""WITH {TAGGED}, words AS (SELECT DISTINCT {TRIM.format("replace(string_split(p, '/')[1], '_', ' ')")} AS w
      FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS p FROM tagged) WHERE instr(p, '/') > 1)
    SELECT DISTINCT lower(w) AS word FROM words WHERE NOT regexp_matches(w, '[.,-]')
      AND NOT ((NOT regexp_matches(w, '\\s') AND regexp_matches(w, '^\\p{{Lu}}'))
        OR len(list_filter(regexp_split_to_array(w, '\\s+'), lambda s: regexp_matches(s, '^\\p{{Ll}}'))) = 0)""",
)
def cor_04(spark: SparkSession, d: str) -> DataFrame:
    return C.tagged_words(tagged_documents(spark, d), "text")


def _pieces_sql(pattern: str) -> str:
    return f"""SELECT DISTINCT {TRIM.format('p')} AS word FROM (
      SELECT unnest(regexp_split_to_array(text, '{pattern}')) AS p FROM documents)
      WHERE NOT regexp_matches(p, '\\p{{Lu}}') AND {TRIM.format('p')} <> ''"""


@query("cor_05_find_words", _pieces_sql("[\\d.,:;?^!~\\[\\](){}$&#''\"@|+\\-/]+"))
def cor_05(spark: SparkSession, d: str) -> DataFrame:
    return C.find_words(documents(spark, d), "text")


@query("cor_06_find_syllables", _pieces_sql("[\\s\\d.,:;?^!~\\[\\](){}$&#''\"@|+\\-/]+"))
def cor_06(spark: SparkSession, d: str) -> DataFrame:
    return C.find_syllables(documents(spark, d), "text")


def sentence_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of all documents as a word list with entries of any length."""
    return documents(spark, d).select("doc_id", F.posexplode(F.split("text", r"[\n,.]")).alias("pos", "line"))


LINES = """lines AS (SELECT doc_id, i - 1 AS pos, parts[i] AS line FROM (
  SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
  SELECT doc_id, regexp_split_to_array(text, '[\\n,.]') AS parts FROM documents)))"""


@query(
    "cor_07_lexicon_profile",
    f"""WITH {LINES}, sized AS (SELECT least(len(regexp_split_to_array({TRIM.format('line')}, '\\s+')), 5) AS k FROM lines)
    SELECT n_syllables, (SELECT count(*) FROM sized WHERE k = n_syllables) AS n,
      CAST(round(CAST((SELECT count(*) FROM sized WHERE k = n_syllables) * 100 AS DECIMAL(28, 6)) / (SELECT count(*) FROM sized), 2)
        AS DECIMAL(10, 2)) AS percent
    FROM (SELECT unnest(range(1, 6)) AS n_syllables)""",
)
def cor_07(spark: SparkSession, d: str) -> DataFrame:
    lines = sentence_lines(spark, d).select(X.trimmed(F.col("line")).alias("line"))
    return C.lexicon_profile(lines, "line")


@query(
    "cor_08_merge_word_lists",
    "SELECT p_name AS word FROM part UNION SELECT p_type FROM part",
)
def cor_08(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return C.merge_word_lists(part.select(F.col("p_name").alias("word")), part.select(F.col("p_type").alias("word")))


@query(
    "cor_09_sort_lines",
    f"""WITH {LINES}, kept AS (SELECT {TRIM.format('line')} AS line FROM lines WHERE {TRIM.format('line')} <> '')
    SELECT row_number() OVER (ORDER BY line) AS rank, line FROM kept""",
)
def cor_09(spark: SparkSession, d: str) -> DataFrame:
    from chatterloom.operators.scale import global_rank

    lines = C.sort_lines(sentence_lines(spark, d), "line", tidy=True)
    return global_rank(lines, [F.col("line")])


@query(
    "cor_10_line_differences",
    """SELECT line_no, 'Line ' || line_no || ': ' || a || ' # ' || b AS difference FROM (
      SELECT doc_id + 1 AS line_no, text AS a, replace(text, 'the ', 'The ') AS b FROM documents) WHERE a <> b""",
)
def cor_10(spark: SparkSession, d: str) -> DataFrame:
    left = documents(spark, d).select((F.col("doc_id") + 1).alias("line_no"), F.col("text").alias("line"))
    right = left.select("line_no", F.replace("line", F.lit("the "), F.lit("The ")).alias("line"))
    return C.line_differences(left, right)


@query(
    "cor_11_rebuild_sentences",
    """WITH tokens AS (SELECT doc_id, i - 1 AS pos, parts[i] AS token FROM (
      SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT doc_id, regexp_split_to_array(text, '\\s') AS parts FROM documents))),
    numbered AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(token, '[.!?]') THEN 1 ELSE 0 END) OVER (
      PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM tokens)
    SELECT doc_id, CAST(sentence AS BIGINT) AS sentence, 0 AS part, string_agg(token, ' ' ORDER BY pos) AS text
    FROM numbered GROUP BY doc_id, sentence""",
)
def cor_11(spark: SparkSession, d: str) -> DataFrame:
    return C.rebuild_sentences(token_rows(spark, d), ["doc_id"])


@query(
    "cor_12_clean_word_list",
    f"WITH {LINES} SELECT DISTINCT {TRIM.format('line')} AS word FROM lines WHERE {TRIM.format('line')} <> ''",
)
def cor_12(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_word_list(sentence_lines(spark, d), "line")
