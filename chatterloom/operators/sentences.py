"""Sentence boundaries learned from unlabelled text.

A period ends a sentence unless it belongs to an abbreviation, and nobody says which words are abbreviations. They are found by
counting: a log-likelihood ratio asks whether a word stands with its period far more often than words do by chance, weighted for short words and
periods inside. The same ratio for pairs finds words that follow each other (``No. 5``) and words that start sentences. What follows an
abbreviation decides whether it also ends the sentence: a word in capitals that elsewhere is written small and never large inside a sentence does.

All statistics are counts over all texts, combined before the shuffle; decisions are made for the few periods in doubt, and texts are cut
in place. Null and blank texts have no sentences. Sentences are joined by single blanks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.operators.scale import broadcast_if_small, cut_lineage

# How often a true abbreviation stands with its period, and the scores from which statistics count.
WITH_PERIOD = 0.99
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
OPENING, CLOSING = r"""^["'(\[“‘]+""", r"""["')\]”’]+$"""


@dataclass
class Boundaries:
    """Learned tables: words with their counts and score, how words are written, pairs, sentence starters."""

    words: DataFrame
    writing: DataFrame
    pairs: DataFrame
    starters: DataFrame

    def abbreviations(self) -> DataFrame:
        return self.words.where(F.col("score") >= ABBREVIATION).select("word")


def tokens_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def _bare(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, OPENING, ""), CLOSING, "")


def _word(bare: Column) -> Column:
    return F.lower(F.regexp_replace(bare, r"\.$", ""))


def _running(texts: DataFrame, text: str) -> DataFrame:
    """(token, word, period, before, next): every token with its neighbours."""
    listed = texts.select(F.transform(tokens_of(F.col(text)), _bare).alias("_t"))
    at = lambda i: F.coalesce(F.get("_t", i), F.lit(""))
    placed = listed.select("_t", F.posexplode("_t").alias("_i", "token"))
    return placed.select("token", _word(F.col("token")).alias("word"), F.col("token").endswith(".").alias("period"), at(F.col("_i") - 1).alias("before"), at(F.col("_i") + 1).alias("next"))


def _log_times(n: Column, p: Column) -> Column:
    """n ln p, where 0 ln 0 is 0."""
    return F.when(n == 0, F.lit(0.0)).otherwise(n * F.ln(p))


def period_scores(texts: DataFrame, text: str) -> DataFrame:
    """``word, n_with, n_without, score``: occurrences with and without a period, and how much the word looks like an abbreviation."""
    n_with = F.sum(F.col("period").cast("long")).alias("n_with")
    counted = _running(texts, text).where("word != ''").groupBy("word").agg(n_with, F.count(F.lit(1)).alias("n")).withColumn("n_without", F.col("n") - F.col("n_with"))
    counted = cut_lineage(counted)
    total = counted.agg(F.sum("n").alias("n"), F.sum("n_with").alias("w")).first()
    chance = F.lit((total["w"] or 0) / total["n"] if total["n"] else 0.5)
    by_chance = _log_times(F.col("n_with"), chance) + _log_times(F.col("n_without"), 1 - chance)
    as_one = F.col("n_with") * F.ln(F.lit(WITH_PERIOD)) + F.col("n_without") * F.ln(F.lit(1 - WITH_PERIOD))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    inside = F.length("word") - letters
    score = -2 * (by_chance - as_one) * F.exp(-letters) * (inside + 1) * F.pow(letters.cast("double"), -F.col("n_without").cast("double"))
    is_word = F.col("word").rlike(r"\p{L}") & (F.col("n_with") > 0) & (letters > 0)
    return counted.select("word", "n_with", "n_without", F.when(is_word, score).otherwise(0.0).alias("score"))


def pair_score(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Log-likelihood ratio of b after a against b anywhere; 0 where it is rarer after a."""
    p, p1, p2 = b / n, both / a, F.when(n > a, (b - both) / (n - a)).otherwise(0.0)
    rest = n - a - b + both
    alone = _log_times(both, p) + _log_times(a - both, 1 - p) + _log_times(b - both, p) + _log_times(rest, 1 - p)
    tied = _log_times(both, p1) + _log_times(a - both, 1 - p1) + _log_times(b - both, p2) + _log_times(rest, 1 - p2)
    return F.when(both / a > b / n, -2 * (alone - tied)).otherwise(0.0)


def _doubtful(abbreviation: Column) -> Column:
    """Does the period of a token belong to the token: abbreviations, initials, ordinals, dots in a row?"""
    return abbreviation | F.col("word").rlike(r"^(?:\p{L}|\d+)$") | F.col("token").endswith("..")


def learn(texts: DataFrame, text: str) -> Boundaries:
    words = cut_lineage(period_scores(texts, text))
    n = words.agg(F.coalesce(F.sum(F.col("n_with") + F.col("n_without")), F.lit(0)).alias("n")).first()["n"]
    known = words.select("word", (F.col("n_with") + F.col("n_without")).alias("n"), (F.col("score") >= ABBREVIATION).alias("short"))
    rows = _running(texts, text)
    first = F.substring("token", 1, 1)
    large = (F.upper(first) == first) & (F.lower(first) != first)
    small = (F.lower(first) == first) & (F.upper(first) != first)
    inside = (F.col("before") != "") & ~F.col("before").rlike(r"[.?!]$")
    writing = rows.groupBy("word").agg(F.max(small).alias("small"), F.max(large & inside).alias("large_inside"))
    # Pairs are counted only after a period, before any statistic is joined.
    after = rows.where(F.col("period") & (F.col("next") != "")).groupBy("token", "word", _word(F.col("next")).alias("follower")).agg(F.count(F.lit(1)).alias("n_both"))
    after = cut_lineage(after.join(known.withColumnRenamed("n", "n_word"), "word").withColumn("doubt", _doubtful(F.col("short"))))
    followers = known.select(F.col("word").alias("follower"), F.col("n").alias("n_follower"))
    # After an abbreviation the next word decides; pairs tell about numbers and initials, which look like ends of sentences.
    tied = after.where(F.col("word").rlike(r"^(?:\p{L}|\d+)$")).groupBy("word", "follower").agg(F.sum("n_both").alias("n_both"), F.max("n_word").alias("n_word")).join(followers, "follower")
    pairs = tied.where(pair_score(F.col("n_both"), F.col("n_word"), F.col("n_follower"), F.lit(n)) >= COLLOCATION).where("n_both > 1")
    ends = after.where("NOT doubt").groupBy("follower").agg(F.sum("n_both").alias("n_both"))
    breaks = ends.agg(F.coalesce(F.sum("n_both"), F.lit(1))).first()[0]
    starters = ends.join(followers, "follower").where(pair_score(F.col("n_both"), F.lit(breaks), F.col("n_follower"), F.lit(n)) >= STARTER)
    return Boundaries(words, cut_lineage(writing), cut_lineage(pairs.select("word", "follower")), cut_lineage(starters.select("follower")))


def sentences(texts: DataFrame, row_id: str, text: str, learned: Boundaries) -> DataFrame:
    """``row_id, sentence_no, sentence`` of every text with words. Rows that share an id are cut by their own texts."""
    key = [row_id, "_text"]
    base = texts.select(row_id, F.col(text).alias("_whole"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_text")).withColumn("_t", tokens_of(F.col("_whole"))).where(F.size("_t") > 0)
    bare = lambda i: _bare(F.get("_t", i))
    spots = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: (i < F.size("_t") - 1) & bare(i).rlike(r"[.?!]$"))
    # An end carries its two tokens, never the text around it.
    around = F.transform(spots, lambda i: F.struct(i.alias("_i"), bare(i).alias("token"), bare(i + 1).alias("next")))
    ends = base.select(*key, F.inline(around)).distinct()
    ends = ends.withColumn("word", _word(F.col("token"))).withColumn("follower", _word(F.col("next")))
    facts = (
        ends.join(broadcast_if_small(learned.abbreviations().withColumn("_short", F.lit(True))), "word", "left")
        .join(broadcast_if_small(learned.pairs.withColumn("_tied", F.lit(True))), ["word", "follower"], "left")
        .join(broadcast_if_small(learned.starters.withColumn("_starts", F.lit(True))), "follower", "left")
        .join(learned.writing.withColumnRenamed("word", "follower"), "follower", "left")
    )
    is_true = lambda c: F.coalesce(F.col(c), F.lit(False))
    head = F.substring("next", 1, 1)
    large = (F.upper(head) == head) & (F.lower(head) != head)
    initial = F.col("word").rlike(r"^\p{L}$")
    also_ends = large & ((is_true("small") & ~is_true("large_inside")) | (is_true("_starts") & ~initial))
    lone = F.col("token").endswith(".")
    ordinal = F.col("word").rlike(r"^\d+$")
    doubt = _doubtful(is_true("_short")) & ~(ordinal & large)
    decided = F.when(~lone, True).when(is_true("_tied"), False).when(doubt, also_ends).otherwise(True)
    cuts = facts.where(decided).groupBy(*key).agg(F.array_sort(F.collect_set("_i")).alias("_cuts"))
    same = base[row_id].eqNullSafe(F.col("_id")) & (base["_text"] == F.col("_key"))
    met = base.join(cuts.select(F.col(row_id).alias("_id"), F.col("_text").alias("_key"), "_cuts"), same, "left")
    marks = met.withColumn("_e", F.concat(F.coalesce("_cuts", F.array().cast("array<int>")), F.array(F.size("_t") - 1)))
    pieces = F.transform("_e", lambda e, i: F.array_join(F.slice("_t", F.when(i == 0, 1).otherwise(F.get("_e", i - 1) + 2), e - F.when(i == 0, -1).otherwise(F.get("_e", i - 1))), " "))
    return marks.select(row_id, F.posexplode(pieces).alias("sentence_no", "sentence"))
