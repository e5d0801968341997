"""Language-model queries over the whitespace tokens of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.operators import ngram as N
from chatterloom.operators.scale import kept_table
from chatterloom.plans.registry import query
from chatterloom.plans.txt import documents, documents_in_order


def token_arrays(spark: SparkSession, d: str, read=documents) -> DataFrame:
    tokens = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    return read(spark, d).select("doc_id", tokens.alias("tokens"))


def unigrams(spark: SparkSession, d: str) -> DataFrame:
    return N.unigram_counts(token_arrays(spark, d).select(F.explode("tokens").alias("token")))


def bigrams(spark: SparkSession, d: str) -> DataFrame:
    return N.bigram_counts(token_arrays(spark, d), "tokens")


TOKENS = """arrays AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS tokens FROM documents),
tokens AS (SELECT doc_id, i - 1 AS pos, tokens[i] AS token FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM arrays)),
unigram AS (SELECT token, count(*) AS freq FROM tokens GROUP BY token)"""
BIGRAMS = """pairs AS (SELECT lag(token, 1, '') OVER (PARTITION BY doc_id ORDER BY pos) AS first, token AS second FROM tokens),
bigram AS (SELECT first, second, count(*) AS freq FROM pairs GROUP BY first, second)"""
COND = """cond AS (SELECT b.first, b.second, b.freq, b.freq / u.freq AS prob FROM bigram b JOIN unigram u ON b.first = u.token)"""


@query("lm_01_unigram_counts", f"WITH {TOKENS} SELECT token, freq FROM unigram")
def lm_01(spark: SparkSession, d: str) -> DataFrame:
    return unigrams(spark, d)


@query("lm_02_vocabulary", f"WITH {TOKENS} SELECT token FROM unigram WHERE freq >= 5")
def lm_02(spark: SparkSession, d: str) -> DataFrame:
    return N.vocabulary(unigrams(spark, d), 5)


@query("lm_03_bigram_counts", f"WITH {TOKENS}, {BIGRAMS} SELECT first, second, freq FROM bigram")
def lm_03(spark: SparkSession, d: str) -> DataFrame:
    return bigrams(spark, d)


@query(
    "lm_03_bigram_counts_of_lines",
    f"""WITH {TOKENS}, {BIGRAMS} SELECT lower(first) AS first, lower(second) AS second, CAST(sum(freq) AS BIGINT) AS freq
    FROM bigram GROUP BY ALL""",
)
def lm_03_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = token_arrays(spark, d, documents_in_order).select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    return N.bigram_counts_of_lines(lines, ["doc_id"], "pos", "token", ignore_case=True)


@query("lm_04_token_total", f"WITH {TOKENS} SELECT CAST(sum(freq) AS BIGINT) AS total FROM unigram")
def lm_04(spark: SparkSession, d: str) -> DataFrame:
    return N.total_count(unigrams(spark, d))


@query(
    "lm_05_unigram_probability",
    f"""WITH {TOKENS}, wanted AS (SELECT DISTINCT unnest(regexp_split_to_array(p_name, ' ')) AS token FROM part
      UNION SELECT token FROM unigram)
    SELECT w.token, round(coalesce(u.freq / (SELECT sum(freq) FROM unigram), 0), 12) AS prob
    FROM wanted w LEFT JOIN unigram u ON w.token = u.token""",
)
def lm_05(spark: SparkSession, d: str) -> DataFrame:
    from chatterloom.plans.registry import table

    counts = unigrams(spark, d)
    names = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("token"))
    wanted = names.union(counts.select("token")).distinct()
    return N.unigram_probability(wanted, counts).withColumn("prob", F.round("prob", 12))


@query(
    "lm_06_conditional_probability",
    f"WITH {TOKENS}, {BIGRAMS}, {COND} SELECT first, second, freq, round(prob, 9) AS prob FROM cond",
)
def lm_06(spark: SparkSession, d: str) -> DataFrame:
    return N.conditional_probability(bigrams(spark, d), unigrams(spark, d)).withColumn("prob", F.round("prob", 9))


@query(
    "lm_07_interpolation_round",
    f"""WITH {TOKENS}, {BIGRAMS}, p AS (SELECT b.freq, coalesce(b.freq / f.freq, 0) AS pc,
      coalesce(s.freq / (SELECT sum(freq) FROM unigram), 0) AS pu
      FROM bigram b LEFT JOIN unigram f ON b.first = f.token LEFT JOIN unigram s ON b.second = s.token),
    c AS (SELECT sum(freq * 0.5::DOUBLE * pc / (0.5::DOUBLE * pc + 0.5::DOUBLE * pu)) AS c1,
      sum(freq * 0.5::DOUBLE * pu / (0.5::DOUBLE * pc + 0.5::DOUBLE * pu)) AS c2 FROM p WHERE pc + pu > 0)
    SELECT round(c1 / (c1 + c2), 8) AS lambda1, round(c2 / (c1 + c2), 8) AS lambda2 FROM c""",
)
def lm_07_round(spark: SparkSession, d: str) -> DataFrame:
    weights = N.interpolation_round(bigrams(spark, d), unigrams(spark, d))
    return weights.select(F.round("lambda1", 8).alias("lambda1"), F.round("lambda2", 8).alias("lambda2"))


@query("lm_07_interpolation_weights")
def lm_07(spark: SparkSession, d: str) -> DataFrame:
    lambda1, lambda2, rounds = N.interpolation_weights(bigrams(spark, d), unigrams(spark, d))
    return spark.createDataFrame([(lambda1, lambda2, rounds)], "lambda1 double, lambda2 double, rounds int")


@query(
    "lm_08_pairs_starting_with",
    f"WITH {TOKENS}, {BIGRAMS} SELECT first, second, freq FROM bigram WHERE first = 'the'",
)
def lm_08(spark: SparkSession, d: str) -> DataFrame:
    return N.pairs_starting_with(bigrams(spark, d), "the")


@query(
    "lm_09_resolve_ambiguities",
    f"""WITH {TOKENS}, {BIGRAMS}, {COND},
    triples AS (SELECT DISTINCT tokens[i] AS first, tokens[i + 1] AS second, tokens[i + 2] AS third FROM (
      SELECT tokens, unnest(range(1, len(tokens) - 1)) AS i FROM arrays)),
    scored AS (SELECT c.first, c.second, 0.996::DOUBLE * c.prob + 0.004::DOUBLE * coalesce(u.freq, 0) AS score
      FROM cond c LEFT JOIN unigram u ON c.second = u.token)
    SELECT t.first, t.second, t.third, coalesce(a.score, 0) >= coalesce(b.score, 0) AS is_first_group FROM triples t
      LEFT JOIN scored a ON t.first = a.first AND t.second = a.second
      LEFT JOIN scored b ON t.second = b.first AND t.third = b.second""",
)
def lm_09(spark: SparkSession, d: str) -> DataFrame:
    return N.resolve_ambiguities_of_texts(token_arrays(spark, d), "tokens", kept_table(unigrams(spark, d)))
