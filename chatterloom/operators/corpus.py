"""Corpus conversion and word-list jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.functions import fixed_values as V
from chatterloom.functions import text as X
from chatterloom.operators.scale import NEST_ROWS, join_null_safe, running_sum


def untag(tagged: Column) -> Column:
    """``word/TAG word/TAG`` to plain tokens, treebank marks removed."""
    pairs = F.filter(F.split(tagged, r"\s+"), lambda p: ~p.rlike("^/+$"))
    words = F.transform(pairs, lambda p: F.substring_index(p, "/", 1))
    return X.drop_treebank_marks(X.trimmed(F.array_join(words, " ")))


def raw_text(tokenised: Column) -> Column:
    """Tokenised text to running text: underscores and loose punctuation disappear."""
    return X.trim_quotations(X.tighten_punctuation(F.replace(tokenised, F.lit("_"), F.lit(" "))))


def tagged_words(df: DataFrame, tagged: str, prune_names: bool = True) -> DataFrame:
    """Distinct words of tagged text, sorted; names and joined words are left out on request."""
    pair = df.select(F.explode(F.split(tagged, r"\s+")).alias("pair")).where(F.instr("pair", "/") > 1)
    word = X.trimmed(F.replace(F.substring_index("pair", "/", 1), F.lit("_"), F.lit(" ")))
    words = pair.select(word.alias("word"))
    if prune_names:
        words = words.where(~X.has_joining_punctuation(F.col("word")) & ~X.is_name(F.col("word")))
        words = words.select(F.lower("word").alias("word"))
    return words.distinct().orderBy("word")


def _plain_pieces(df: DataFrame, text: str, pattern: str) -> DataFrame:
    piece = df.select(F.explode(F.split(text, pattern)).alias("piece"))
    lower_only = piece.where(~F.col("piece").rlike(r"\p{Lu}")).select(X.trimmed(F.col("piece")).alias("word"))
    return lower_only.where("word != ''").distinct().orderBy("word")


def find_words(df: DataFrame, text: str) -> DataFrame:
    """Distinct pieces between digits and punctuation that have no upper-case letter, sorted."""
    return _plain_pieces(df, text, V.WORD_LISTS_SPLIT)


def find_syllables(df: DataFrame, text: str) -> DataFrame:
    """As ``find_words``, with blanks as separators too."""
    return _plain_pieces(df, text, V.SYLLABLE_LISTS_SPLIT)


def lexicon_profile(lexicon: DataFrame, word: str) -> DataFrame:
    """Entries by number of syllables (1, 2, 3, 4, 5 and more), with their percentage."""
    size = F.least(F.size(F.split(word, r"\s+")), F.lit(5))
    counts = lexicon.agg(
        *[F.count(F.when(size == n, 1)).alias(f"n{n}") for n in range(1, 6)], F.count("*").alias("total")
    )
    rows = F.array(*[F.struct(F.lit(n).alias("n_syllables"), F.col(f"n{n}").alias("n")) for n in range(1, 6)])
    percent = F.round((F.col("n") * 100).cast("decimal(28,6)") / F.col("total"), 2).cast("decimal(10,2)")
    return counts.select("total", F.inline(rows)).select("n_syllables", "n", percent.alias("percent"))


def merge_word_lists(left: DataFrame, right: DataFrame, word: str = "word") -> DataFrame:
    """Distinct words of both lists, sorted."""
    return left.select(word).union(right.select(word)).distinct().orderBy(word)


def sort_lines(lines: DataFrame, line: str, tidy: bool = False) -> DataFrame:
    """All lines in binary order; with ``tidy`` trimmed and without blank ones."""
    column = X.trimmed(F.col(line)) if tidy else F.col(line)
    kept = lines.select(column.alias(line))
    return (kept.where(F.col(line) != "") if tidy else kept).orderBy(line)


def line_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines (``line_no`` from 1, ``line``) that differ, up to the end of the shorter side."""
    other = right.select("line_no", F.col("line").alias("_other"))
    report = F.format_string("Line %d: %s # %s", F.col("line_no"), F.col("line"), F.col("_other"))
    return (
        left.select("line_no", "line")
        .join(other, "line_no")
        .where(F.col("line") != F.col("_other"))
        .select("line_no", report.alias("difference"))
    )


def rebuild_sentences(
    tokens: DataFrame, group: Sequence[str], pos: str = "pos", token: str = "token", size: int = NEST_ROWS, block: int = 1_000_000
) -> DataFrame:
    """Running text from one token per row; a sentence ends at a token with ``.``, ``!`` or ``?``.

    A sentence of more than ``size`` tokens continues in further rows (``part``), so a stretch
    without sentence ends cannot fill one task.
    """
    group = list(group)
    ends = tokens.select(*group, pos, token, F.col(token).rlike(V.SENTENCE_END_MARKS).cast("int").alias("_end"))
    if (tokens.agg(F.max(pos)).first()[0] or 0) < block:
        # No group is longer than a block: number, start and part of a sentence come from one sorted pass.
        inside = Window.partitionBy(*group).orderBy(pos)
        begins = F.when(F.lag("_end", 1, 1).over(inside) == 1, F.col(pos))
        before = inside.rowsBetween(Window.unboundedPreceding, -1)
        numbered = ends.withColumn("_begin", begins).select(
            *group, pos, token, F.coalesce(F.sum("_end").over(before), F.lit(0)).alias("sentence"), F.max("_begin").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_start")
        )
    else:
        numbered = running_sum(ends, group, pos, F.col("_end"), "sentence", block)
        starts = numbered.groupBy(*group, "sentence").agg(F.min(pos).alias("_start"))
        numbered = join_null_safe(numbered, starts, [*group, "sentence"])
    placed = numbered.withColumn("part", F.floor((F.col(pos) - F.col("_start")) / size))
    lists = placed.groupBy(*group, "sentence", "part").agg(F.array_sort(F.collect_list(F.struct(pos, token))).alias("_t"))
    return lists.select(*group, "sentence", "part", F.array_join(F.transform("_t", lambda t: t[token]), " ").alias("text"))


def clean_word_list(words: DataFrame, word: str) -> DataFrame:
    """Trimmed, non-blank, distinct, sorted: the content of lexicon records."""
    return words.select(X.trimmed(F.col(word)).alias("word")).where("word != ''").distinct().orderBy("word")
