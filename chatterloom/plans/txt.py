"""Text cleaning queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.functions import fixed_values as V
from chatterloom.functions import text as X
from chatterloom.operators import cleaning as C
from chatterloom.operators.scale import in_order, spread_few_files
from chatterloom.plans.registry import query, table

# Lookups for the language of the given texts; each is an ordinary argument of its operator.
SPELLING = [("nd", "and"), ("th", "the"), ("wh", "which"), ("ee", "the tree"), ("ou", "où"), ("ti", "to"), ("the", "THE")]
EMOTICONS = [("***", " stars "), ("###", " marks "), ("%%%", " shares "), ("-->", " arrow "), ("--", " dash ")]
EMOJI = [(":nav", " menu"), ("&amp;", " and"), ("➔", " next"), ("—", " dash"), ("é", "e"), ("\U0001f600", " smile")]
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "with", "this", "from", "les", "des", "und", "der", "die"]


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_pairs(pairs: list[tuple[str, str]], name: str = "lookup") -> str:
    rows = ", ".join(f"({i}, {sql_text(k)}, {sql_text(v)})" for i, (k, v) in enumerate(pairs))
    return f"{name}(line, key, value) AS (VALUES {rows})"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(sql_text(w) for w in words) + "]"


def lookup(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(pairs, "key string, value string")


def stop_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread_few_files(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def documents_in_order(spark: SparkSession, d: str) -> DataFrame:
    """For queries that group or sort what they cut out of the texts by document."""
    return in_order(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    pages = spread_few_files(table(spark, d, "pages").select("page_id", "url", "html"), "page_id")
    return pages.select(F.col("page_id").alias("doc_id"), F.concat_ws(" ", "url", "html").alias("text"))


PAGE_TEXTS = "page_texts AS (SELECT page_id AS doc_id, url || ' ' || html AS text FROM pages)"
URL = r"https?:(?://|\\)+[\w:#@%/;$()~?+,\-.<=\\&]*"
URL_TO_BLANK = f"regexp_replace({{}}, {sql_text(URL)}, ' ', 'g')"


def _decomposed(text: str) -> F.Column:
    out = F.col(text)
    for letter, parts in (("é", "é"), ("è", "è"), ("É", "É"), ("à", "à")):
        out = F.replace(out, F.lit(letter), F.lit(parts))
    return out


@query(
    "txt_01_compose_letters",
    """SELECT doc_id, nfc_normalize(replace(replace(replace(replace(text, 'é', 'e' || chr(769)), 'è', 'e' || chr(768)),
      'É', 'E' || chr(769)), 'à', 'a' || chr(768))) AS text FROM documents""",
)
def txt_01(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", X.compose_letters(_decomposed("text")).alias("text"))


@query(
    "txt_02_correct_spelling",
    f"""WITH {sql_pairs(SPELLING)}, words AS (SELECT map(list(key), list(value)) AS m FROM lookup)
    SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'),
      lambda p: coalesce(m[lower(p)], p)), '') AS text FROM documents, words""",
)
def txt_02(spark: SparkSession, d: str) -> DataFrame:
    return C.correct_spelling(documents(spark, d), "doc_id", "text", lookup(spark, SPELLING))


@query(
    "txt_03_emoticons",
    rf"""WITH {PAGE_TEXTS}, marked AS (SELECT doc_id, text,
      regexp_extract_all(text, '\*\*\*|###|%%%|-->|--|(?s:.)') AS parts FROM page_texts),
    {sql_pairs(EMOTICONS)}, words AS (SELECT map(list(key), list(value)) AS m FROM lookup)
    SELECT doc_id, array_to_string(list_transform(parts, lambda p, i: CASE WHEN m[p] IS NOT NULL
      AND NOT regexp_matches(coalesce(right(parts[i - 1], 1), ''), '^\w$')
      AND NOT regexp_matches(coalesce(left(parts[i + 1], 1), ''), '^\w$') THEN m[p] ELSE p END), '') AS text
    FROM marked, words""",
)
def txt_03(spark: SparkSession, d: str) -> DataFrame:
    return C.correct_emoticons(page_texts(spark, d), "doc_id", "text", lookup(spark, EMOTICONS))


@query(
    "txt_04_emoji",
    f"""WITH {sql_pairs(EMOJI)}, words AS (SELECT map(list(key), list(value || ' ')) AS m FROM lookup)
    SELECT doc_id, array_to_string(list_transform(
      regexp_extract_all(text, ':nav|&amp;|➔|—|é|{EMOJI[-1][0]}|(?s:.)'), lambda p: coalesce(m[p], p)), '') AS text
    FROM documents, words""",
)
def txt_04(spark: SparkSession, d: str) -> DataFrame:
    return C.correct_emoji(documents(spark, d), "doc_id", "text", lookup(spark, EMOJI))


@query(
    "txt_05_clean_text",
    rf"""WITH lookups AS (SELECT
      map({sql_list([k for k, _ in EMOTICONS])}, {sql_list([v for _, v in EMOTICONS])}) AS e,
      map({sql_list([k for k, _ in EMOJI])}, {sql_list([v + ' ' for _, v in EMOJI])}) AS j,
      map({sql_list([k for k, _ in SPELLING])}, {sql_list([v for _, v in SPELLING])}) AS s),
    marked AS (SELECT conv_id, turn, regexp_extract_all(text, '\*\*\*|###|%%%|-->|--|(?s:.)') AS parts FROM conversations),
    one AS (SELECT conv_id, turn, s, j, array_to_string(list_transform(parts, lambda p, i: CASE WHEN e[p] IS NOT NULL
      AND NOT regexp_matches(coalesce(right(parts[i - 1], 1), ''), '^\w$')
      AND NOT regexp_matches(coalesce(left(parts[i + 1], 1), ''), '^\w$') THEN e[p] ELSE p END), '') AS text FROM marked, lookups),
    two AS (SELECT conv_id, turn, s, array_to_string(list_transform(
      regexp_extract_all(text, ':nav|&amp;|➔|—|é|{EMOJI[-1][0]}|(?s:.)'), lambda p: coalesce(j[p], p)), '') AS text FROM one)
    SELECT conv_id * 1000 + turn AS doc_id, array_to_string(list_transform(
      regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), lambda p: coalesce(s[lower(p)], p)), '') AS text FROM two""",
)
def txt_05(spark: SparkSession, d: str) -> DataFrame:
    talks = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return C.clean_text(talks, "doc_id", "text", lookup(spark, EMOTICONS), lookup(spark, EMOJI), lookup(spark, SPELLING))


def _simple(name: str, expression: str, apply, pages: bool = True) -> None:
    """A query of one column expression over the whole page (or document) texts."""
    if pages:
        sql = f"WITH {PAGE_TEXTS} SELECT doc_id, {expression} AS text FROM page_texts"
    else:
        sql = f"SELECT doc_id, {expression} AS text FROM documents"
    source = page_texts if pages else documents

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return source(spark, d).select("doc_id", apply(F.col("text")).alias("text"))


_simple("txt_06_drop_digits_urls", URL_TO_BLANK.format("regexp_replace(text, '[0-9]', '', 'g')"), X.drop_digits_and_urls)
_simple("txt_07_digits_to_blank", "regexp_replace(text, '[0-9]', ' ', 'g')", X.digits_to_blank)
_simple(
    "txt_08_urls_symbols_to_blank",
    f"translate({URL_TO_BLANK.format('text')}, {sql_text(V.SYMBOLS_TO_BLANK)}, {sql_text(' ' * len(V.SYMBOLS_TO_BLANK))})",
    X.urls_and_symbols_to_blank,
)
_simple("txt_09_urls_to_blank", URL_TO_BLANK.format("text"), X.urls_to_blank)
_simple("txt_10_angle_brackets", "translate(text, '<>', '  ')", X.angle_brackets_to_blank)


@query(
    "txt_11_stop_word_test",
    f"""SELECT word, length(word) < 2 OR list_contains({sql_list(STOP_WORDS)}, lower(word)) AS is_stop, count(*) AS n
    FROM (SELECT unnest(regexp_split_to_array(text, '[^\\p{{L}}]+')) AS word FROM documents) GROUP BY word""",
)
def txt_11(spark: SparkSession, d: str) -> DataFrame:
    words = documents(spark, d).select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.select("word", X.is_stop_word(F.col("word"), STOP_WORDS).alias("is_stop"), "n")


@query(
    "txt_12_remove_stop_words",
    f"""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'),
      lambda w: length(w) >= 2 AND NOT list_contains({sql_list(STOP_WORDS)}, lower(w))), lambda w: w || ' '), '') AS text
    FROM documents""",
)
def txt_12(spark: SparkSession, d: str) -> DataFrame:
    return C.remove_stop_words(documents(spark, d), "doc_id", "text", stop_words(spark))


@query(
    "txt_13_lower_unless_caps",
    """SELECT token, count(*) AS n FROM (SELECT CASE WHEN w = upper(w) THEN w ELSE lower(w) END AS token
    FROM (SELECT unnest(regexp_split_to_array(text, '\\s')) AS w FROM documents)) GROUP BY token""",
)
def txt_13(spark: SparkSession, d: str) -> DataFrame:
    words = documents(spark, d).select(F.explode(X.whitespace_tokens(F.col("text"))).alias("w"))
    return words.groupBy(X.lower_unless_caps(F.col("w")).alias("token")).agg(F.count("*").alias("n"))


@query(
    "txt_14_whitespace_tokens",
    """SELECT doc_id, len(t) AS n_tokens, array_to_string(t, '|') AS tokens
    FROM (SELECT doc_id, regexp_split_to_array(text, '\\s') AS t FROM documents)""",
)
def txt_14(spark: SparkSession, d: str) -> DataFrame:
    tokens = X.whitespace_tokens(F.col("text"))
    return documents(spark, d).select(
        "doc_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.array_join(tokens, "|").alias("tokens")
    )


# The texts have hardly any Vietnamese spelling, so the queries first put some in.
TONE_SEED = [("ou", "òa"), ("le", "óe"), ("un", "ủy"), ("ea", "ụy")]


def _seeded(text: F.Column) -> F.Column:
    for old, new in TONE_SEED:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


_SEEDED_SQL = "text"
for _old, _new in TONE_SEED:
    _SEEDED_SQL = f"replace({_SEEDED_SQL}, '{_old}', '{_new}')"
MOVED_SQL = "{}"
for _old, _new in V.TONE_MARK_RULES:
    MOVED_SQL = f"replace({MOVED_SQL}, '{_old}', '{_new}')"
_simple("txt_15_move_tone_marks", MOVED_SQL.format(_SEEDED_SQL), lambda t: X.move_tone_marks(_seeded(t)), pages=False)
_simple(
    "txt_16_phrase_key",
    MOVED_SQL.format(f"(lower(left({_SEEDED_SQL}, 1)) || substr({_SEEDED_SQL}, 2))"),
    lambda t: X.phrase_key(_seeded(t)),
    pages=False,
)

_MARK_SEED = "replace(replace(replace(text, ' to ', ' *E* '), ' la ', ' *T*'), ' in ', ' E* ')"
_UNMARKED = _MARK_SEED
for _mark in V.TREEBANK_MARKS:
    _UNMARKED = f"replace({_UNMARKED}, '{_mark}', '')"


def _marked(text: F.Column) -> F.Column:
    for old, new in ((" to ", " *E* "), (" la ", " *T*"), (" in ", " E* ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


_simple("txt_17_treebank_marks", _UNMARKED, lambda t: X.drop_treebank_marks(_marked(t)), pages=False)


def _loose(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"([.,!?:()])", " $1 ")


_LOOSE_SQL = "regexp_replace(text, '([.,!?:()])', ' \\1 ', 'g')"
_simple(
    "txt_18_tighten_punctuation",
    f"""regexp_replace(regexp_replace(regexp_replace({_LOOSE_SQL}, '\\s+', ' ', 'g'), ' ([.,!?:)”])', '\\1', 'g'),
      '([(“]) ', '\\1', 'g')""",
    lambda t: X.tighten_punctuation(_loose(t)),
)
_simple(
    "txt_19_trim_quotations",
    """array_to_string(list_transform(string_split(replace(text, '"', '" '), '"'),
      lambda x, i: CASE WHEN i % 2 = 0 THEN regexp_replace(x, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') ELSE x END), '"')""",
    lambda t: X.trim_quotations(F.replace(t, F.lit('"'), F.lit('" '))),
)


@query(
    "txt_20_name_test",
    """SELECT word, (NOT contains(word, ' ') AND regexp_matches(word, '^\\p{Lu}'))
      OR len(list_filter(string_split(word, ' '), lambda s: regexp_matches(s, '^\\p{Ll}'))) = 0 AS is_name, count(*) AS n
    FROM (SELECT unnest(regexp_split_to_array(text, '[^\\p{L} ]+')) AS word FROM documents) GROUP BY word""",
)
def txt_20(spark: SparkSession, d: str) -> DataFrame:
    words = documents(spark, d).select(F.explode(F.split("text", r"[^\p{L} ]+")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.select("word", X.is_name(F.col("word")).alias("is_name"), "n")


@query(
    "txt_21_joining_punctuation",
    """SELECT word, regexp_matches(word, '[.,-]') AS joined, count(*) AS n
    FROM (SELECT unnest(regexp_split_to_array(text, '\\s')) AS word FROM documents) GROUP BY word""",
)
def txt_21(spark: SparkSession, d: str) -> DataFrame:
    words = documents(spark, d).select(F.explode(X.whitespace_tokens(F.col("text"))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.select("word", X.has_joining_punctuation(F.col("word")).alias("joined"), "n")
