"""Tokenisation queries; lexicon and frequencies come from the documents themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.operators import lexer as L
from chatterloom.operators import ngram as N
from chatterloom.operators import segment as S
from chatterloom.operators import tokenize as T
from chatterloom.operators.scale import cut_lineage
from chatterloom.operators.sentences import ABBREVIATION, learn, period_scores, sentences
from chatterloom.plans.registry import query
from chatterloom.plans.txt import MOVED_SQL, documents, sql_list

MIN_WORD, MIN_PAIR = 5, 10
PREFIXES = ["the", "la", "der", "die", "el", "is", "le"]
DATE_WORDS = {"day": ("of", "de"), "month": ("in", "en"), "year": ("the", "und")}


def phrases(spark: SparkSession, d: str) -> DataFrame:
    """Runs of lower-cased words without punctuation: ``doc_id, pos, phrase``."""
    text = F.regexp_replace(F.lower("text"), r"[\x00-\x20]+", " ")
    pieces = F.posexplode(F.split(text, r"[^\p{L} ]+"))
    return documents(spark, d).select("doc_id", pieces.alias("pos", "phrase")).select("doc_id", "pos", F.trim("phrase").alias("phrase")).where("phrase != ''")


def word_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Single words and neighbouring pairs of the phrases, with their counts."""
    text = F.regexp_replace(F.lower("text"), r"[^\p{L}\x00-\x20]+", ".")
    return N.word_and_pair_counts(documents(spark, d), "text", ".", F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F]", " "))


def lexicon_of(frequencies: DataFrame) -> DataFrame:
    """Frequent words and pairs with their counts: lexicon and frequency table in one."""
    pair = F.contains("word", F.lit(" "))
    return frequencies.where(F.col("freq") >= F.when(pair, MIN_PAIR).otherwise(MIN_WORD))


PHRASES = r"""pieces AS (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(text), '[\x00-\x20]+', ' ', 'g'), '[^\p{L} ]+') AS p FROM documents),
phrases AS (SELECT doc_id, i - 1 AS pos, trim(p[i]) AS phrase FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM pieces)
  WHERE trim(p[i]) <> ''),
syllables AS (SELECT doc_id, pos, regexp_split_to_array(phrase, ' +') AS w FROM phrases),
frequencies AS (SELECT word, count(*) AS freq FROM (
  SELECT unnest(w) AS word FROM syllables UNION ALL
  SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM syllables)) GROUP BY word),
lexicon AS (SELECT word FROM frequencies WHERE freq >= CASE WHEN contains(word, ' ') THEN 10 ELSE 5 END)"""


@query("tok_01_lexer")
def tok_01(spark: SparkSession, d: str) -> DataFrame:
    return L.lex(documents(spark, d), "doc_id", "text")


@query("tok_02_tokenize")
def tok_02(spark: SparkSession, d: str) -> DataFrame:
    lexicon = cut_lineage(lexicon_of(word_frequencies(spark, d)))
    return T.tokenize(documents(spark, d), "doc_id", "text", lexicon, lexicon)


@query(
    "tok_03_candidate_words",
    f"""WITH {PHRASES},
    keyed AS (SELECT doc_id, pos, regexp_split_to_array({MOVED_SQL.format('phrase')}, ' +') AS w FROM phrases),
    spans AS (SELECT doc_id, pos, i - 1 AS start, 1 AS len, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM keyed)
      UNION ALL SELECT doc_id, pos, i - 1, 2, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM keyed))
    SELECT s.doc_id, s.pos, s.start, s.len, s.word, CASE s.len WHEN 1 THEN 100 ELSE 50 END AS weight
    FROM spans s JOIN lexicon l ON s.word = l.word""",
)
def tok_03(spark: SparkSession, d: str) -> DataFrame:
    return S.candidate_words(phrases(spark, d), ["doc_id", "pos"], "phrase", cut_lineage(lexicon_of(word_frequencies(spark, d))))


@query("tok_05_segment_phrases")
def tok_05(spark: SparkSession, d: str) -> DataFrame:
    lexicon = cut_lineage(lexicon_of(word_frequencies(spark, d)))
    found = S.segment_phrases(phrases(spark, d), ["doc_id", "pos"], "phrase", lexicon, lexicon)
    return found.select("doc_id", "pos", "weight", F.array_join("words", "|").alias("words"))


# Two ways to pair the syllables of a phrase: from the first one, or from the second one.
ALTERNATIVES = """alternatives AS (
  SELECT doc_id, pos, 0 AS choice, list_transform(range(1, len(w) + 1, 2), lambda i: concat_ws(' ', w[i], w[i + 1])) AS words FROM syllables
  UNION ALL SELECT doc_id, pos, 1, list_prepend(w[1], list_transform(range(2, len(w) + 1, 2), lambda i: concat_ws(' ', w[i], w[i + 1])))
  FROM syllables)"""


def alternatives(spark: SparkSession, d: str) -> DataFrame:
    w = phrases(spark, d).select("doc_id", "pos", F.split("phrase", " +").alias("w"))

    def paired(words: F.Column) -> F.Column:
        after = F.slice(words, F.lit(2), F.size(words))
        both = F.zip_with(words, after, lambda a, b: F.concat_ws(" ", a, b))
        return F.filter(both, lambda x, i: i % 2 == 0)

    rest = F.slice("w", F.lit(2), F.size("w"))
    choices = F.array(paired(F.col("w")), F.concat(F.slice("w", 1, 1), paired(rest)))
    return w.select("doc_id", "pos", F.posexplode(choices).alias("choice", "words"))


@query(
    "tok_06_resolve_by_frequency",
    f"""WITH {PHRASES}, {ALTERNATIVES},
    sums AS (SELECT a.doc_id, a.pos, a.choice, a.words, CAST(sum(coalesce(f.freq, 0)) AS BIGINT) AS freq FROM (
      SELECT *, unnest(words) AS word FROM alternatives) a LEFT JOIN frequencies f ON a.word = f.word
      GROUP BY a.doc_id, a.pos, a.choice, a.words)
    SELECT doc_id, pos, freq, array_to_string(words, '|') AS words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos
      ORDER BY freq DESC, len(words), words) AS r FROM sums) WHERE r = 1""",
)
def tok_06(spark: SparkSession, d: str) -> DataFrame:
    chosen = S.resolve(alternatives(spark, d), ["doc_id", "pos"], word_frequencies(spark, d))
    return chosen.select("doc_id", "pos", "freq", F.array_join("words", "|").alias("words"))


@query("tok_07_first_segmentation")
def tok_07(spark: SparkSession, d: str) -> DataFrame:
    lexicon = cut_lineage(lexicon_of(word_frequencies(spark, d)))
    found = S.segment_phrases(phrases(spark, d), ["doc_id", "pos"], "phrase", lexicon)
    return found.select("doc_id", "pos", "weight", F.array_join("words", "|").alias("words"))


@query(
    "tok_08_token_line",
    r"""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[.,\n]'),
      lambda t: regexp_matches(t, '[^\x00-\x20]')),
      lambda t: regexp_replace(regexp_replace(t, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '\s+', '_', 'g')), ' ') AS text FROM documents""",
)
def tok_08(spark: SparkSession, d: str) -> DataFrame:
    from chatterloom.functions.text import trimmed

    pieces = documents(spark, d).select("doc_id", F.posexplode(F.split("text", r"[.,\n]")).alias("pos", "token"))
    tokens = pieces.select("doc_id", "pos", F.lit(0).alias("part"), trimmed(F.col("token")).alias("token")).where("token != ''")
    return T.token_line(tokens, "doc_id")


@query(
    "tok_09_split_sentences",
    r"""WITH cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+(\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts
      FROM documents)
    SELECT doc_id, i - 1 AS sentence, parts[i] AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut)""",
)
def tok_09(spark: SparkSession, d: str) -> DataFrame:
    return T.split_sentences(documents(spark, d), "doc_id", "text")


@query(
    "tok_09_period_scores",
    r"""WITH t AS (SELECT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS raw FROM documents),
    b AS (SELECT regexp_replace(regexp_replace(raw, '^["''(\[“‘]+', ''), '["'')\]”’]+$', '') AS token FROM t),
    w AS (SELECT lower(regexp_replace(token, '\.$', '')) AS word, ends_with(token, '.') AS period FROM b),
    c AS (SELECT word, count(*) FILTER (period) AS n_with, count(*) FILTER (NOT period) AS n_without FROM w WHERE word <> '' GROUP BY word),
    p AS (SELECT sum(n_with)::DOUBLE / sum(n_with + n_without) AS p FROM c),
    s AS (SELECT *, length(replace(word, '.', '')) AS l, CASE WHEN n_with = 0 THEN 0 ELSE n_with * ln(p) END + CASE WHEN n_without = 0 THEN 0 ELSE n_without * ln(1 - p) END AS chance,
      n_with * ln(0.99) + n_without * ln(1 - 0.99::DOUBLE) AS one FROM c, p)
    SELECT word, n_with, n_without, CASE WHEN regexp_matches(word, '\p{L}') AND n_with > 0 AND l > 0
      AND -2 * (chance - one) * exp(-l) * (length(word) - l + 1) * pow(l::DOUBLE, -n_without::DOUBLE) >= 0.3 THEN 1 ELSE 0 END AS abbreviation FROM s""",
)
def tok_09_scores(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every word with and without a period, and which ones pass for abbreviations."""
    scored = period_scores(documents(spark, d), "text")
    return scored.select("word", "n_with", "n_without", (F.col("score") >= ABBREVIATION).cast("int").alias("abbreviation"))


@query(
    "tok_09_learned_sentences",
    r"""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), ' ') AS text FROM documents
    WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) > 0""",
)
def tok_09_learned(spark: SparkSession, d: str) -> DataFrame:
    """Every text put together again from the sentences of the learned split: none is lost, repeated or out of order."""
    docs = documents(spark, d).select("doc_id", "text")
    cut = sentences(docs, "doc_id", "text", learn(docs, "text"))
    whole = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sentence_no", "sentence"))).alias("s"))
    return whole.select("doc_id", F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("text"))


TAGGED_TOKENS = r"""raw AS (SELECT doc_id, regexp_extract_all(text, '\p{Lu}\p{Ll}*(?: \p{Lu}\p{Ll}+)*|\p{Ll}+|[0-9]+[-/.][0-9]+|[0-9]+|[^\x00-\x20]') AS t FROM documents),
tokens AS (SELECT doc_id, i - 1 AS pos, t[i] AS token, CASE WHEN regexp_matches(t[i], '^\p{Lu}') THEN 'name2'
  WHEN regexp_matches(t[i], '^(?:19|20)[0-9][0-9]$') THEN 'date_yyyy' WHEN regexp_matches(t[i], '^[0-9]+$') THEN 'number1'
  WHEN regexp_matches(t[i], '^[0-9]+/') THEN 'date_dd-mm' WHEN regexp_matches(t[i], '^[0-9]') THEN 'date_mm-yyyy'
  WHEN regexp_matches(t[i], '^\p{L}') THEN 'phrase' ELSE 'special' END AS rule
  FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM raw))"""


def tagged_tokens(spark: SparkSession, d: str, read=documents) -> DataFrame:
    """Names, words, numbers, date-like pieces and all other characters but blanks, with a rule name each."""
    pattern = F.lit(r"\p{Lu}\p{Ll}*(?: \p{Lu}\p{Ll}+)*|\p{Ll}+|[0-9]+[-/.][0-9]+|[0-9]+|[^\x00-\x20]")
    t = F.col("token")
    rule = (
        F.when(t.rlike(r"^\p{Lu}"), "name2")
        .when(t.rlike("^(?:19|20)[0-9][0-9]$"), "date_yyyy")
        .when(t.rlike("^[0-9]+$"), "number1")
        .when(t.rlike("^[0-9]+/"), "date_dd-mm")
        .when(t.rlike("^[0-9]"), "date_mm-yyyy")
        .when(t.rlike(r"^\p{L}"), "phrase")
        .otherwise("special")
    )
    tokens = read(spark, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("pos", "token"))
    return tokens.withColumn("rule", rule)


@query(
    "tok_10_split_names",
    f"""WITH {TAGGED_TOKENS}, flagged AS (SELECT *, rule LIKE 'name%' AND contains(token, ' ')
      AND list_contains({sql_list(PREFIXES)}, lower(split_part(token, ' ', 1))) AS s FROM tokens)
    SELECT doc_id, pos, 0 AS piece, CASE WHEN s THEN split_part(token, ' ', 1) ELSE token END AS token,
      CASE WHEN s THEN 'word' ELSE rule END AS rule FROM flagged
    UNION ALL SELECT doc_id, pos, 1, substr(token, instr(token, ' ') + 1), 'name' FROM flagged WHERE s""",
)
def tok_10(spark: SparkSession, d: str) -> DataFrame:
    prefixes = spark.createDataFrame([(w,) for w in PREFIXES], "word string")
    return T.split_names(tagged_tokens(spark, d), prefixes)


@query(
    "tok_11_merge_dates",
    f"""WITH {TAGGED_TOKENS}, looked AS (SELECT *, lag(token) OVER w AS before, lag(rule) OVER w AS before_rule,
      lead(token) OVER w AS next, lead(rule) OVER w AS next_rule FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    judged AS (SELECT *, coalesce((before IN ('of', 'de') AND rule LIKE 'date_dd%') OR (before IN ('in', 'en') AND rule LIKE 'date_mm-yy%')
        OR (before IN ('the', 'und') AND (rule = 'date_yyyy' OR rule LIKE 'number%')), false) AS joins,
      coalesce((token IN ('of', 'de') AND next_rule LIKE 'date_dd%') OR (token IN ('in', 'en') AND next_rule LIKE 'date_mm-yy%')
        OR (token IN ('the', 'und') AND (next_rule = 'date_yyyy' OR next_rule LIKE 'number%')), false) AS taken FROM looked)
    SELECT doc_id, pos, CASE WHEN joins THEN before || ' ' || token ELSE token END AS token, rule FROM judged WHERE NOT taken""",
)
def tok_11(spark: SparkSession, d: str) -> DataFrame:
    return T.merge_dates(tagged_tokens(spark, d), ["doc_id"], ["pos"], DATE_WORDS)


@query(
    "tok_12_rule_classes",
    f"""WITH {TAGGED_TOKENS} SELECT rule, count(*) AS n, rule = 'phrase' AS is_phrase, rule LIKE 'name%' AS is_named,
      rule LIKE 'date%' AS is_date, rule LIKE 'date_dd%' AS is_day, rule LIKE 'date_mm-yy%' AS is_month, rule = 'date_yyyy' AS is_year,
      rule LIKE 'number%' AS is_number FROM tokens GROUP BY rule""",
)
def tok_12(spark: SparkSession, d: str) -> DataFrame:
    return L.rule_classes(tagged_tokens(spark, d).groupBy("rule").agg(F.count("*").alias("n")))
