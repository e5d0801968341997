"""Cleaning jobs whose lookup tables are DataFrames of any size.

Lookups are normalised first (``normal_lookup``, ``normal_words``). One within ``INLINE_ROWS`` then becomes part of a native
expression: no shuffle, no join. A larger one is joined: texts give up their candidate substrings, the lookup
decides, texts are rebuilt. Only the join strategy depends on the size. Null texts stay null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.functions import text as X
from chatterloom.operators.scale import INLINE_ROWS, last_per_key, small_rows


def normal_lookup(lookup: DataFrame, any_case: bool = False) -> DataFrame:
    """``key, value`` as every size of lookup is used: no null or empty keys, null values empty, case folded, one row per key.

    Of several values of a key the greatest counts; ``last_meaning`` picks the last line of a file before.
    """
    key = F.lower("key") if any_case else F.col("key")
    filled = lookup.select(key.alias("key"), F.coalesce("value", F.lit("")).alias("value")).where("key != ''")
    return filled.groupBy("key").agg(F.max("value").alias("value"))


def normal_words(words: DataFrame) -> DataFrame:
    """Distinct words without null."""
    return words.select("word").where("word IS NOT NULL").distinct()


def _replace_by_join(df: DataFrame, text: str, lookup: DataFrame, word_bounds: str, any_case: bool) -> DataFrame:
    """Leftmost-longest replacement with the (normal) lookup as a joined table.

    ``word_bounds`` is the class a neighbour must not be in ("" for none). Each distinct text is worked on once, so
    repeated rows cost nothing and stay repeated.
    """
    fold = F.lower if any_case else (lambda c: c)
    lookup = lookup.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    # One number per key length and one character per first letter: bounded, whatever the size of the lookup.
    lengths = [r["_len"] for r in lookup.select(F.length("_key").alias("_len")).distinct().collect()]
    letters = [r["_c"] for r in lookup.select(F.substring("_key", 1, 1).alias("_c")).distinct().collect()]
    chars = df.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct().select("_text", F.split("_text", "").alias("_chars"))
    starts = F.sequence(F.lit(1), F.size("_chars"))
    char_at: Callable[[Column], Column] = lambda i: F.coalesce(F.get("_chars", i - 1), F.lit(""))
    free: Callable[[Column], Column] = lambda c: F.lit(True) if not word_bounds else ~c.rlike(word_bounds)
    # A letter may fold to several; only its first one begins a key.
    starts = F.filter(starts, lambda i: F.substring(fold(char_at(i)), 1, 1).isin(letters) & free(char_at(i - 1)))
    spans = (
        chars.select("_text", "_chars", F.explode(starts).alias("_at"))
        .select("*", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("_len"))
        .where(F.col("_at") + F.col("_len") - 1 <= F.size("_chars"))
        .where(free(char_at(F.col("_at") + F.col("_len"))))
        .select("_text", "_at", "_len", fold(F.array_join(F.slice("_chars", F.col("_at"), F.col("_len")), "")).alias("_key"))
    )
    hits = (
        spans.join(lookup, "_key")
        .groupBy("_text")
        .agg(F.array_sort(F.collect_list(F.struct("_at", (-F.col("_len")).alias("_neg"), "_value"))).alias("_hits"))
    )
    between = lambda a, b: F.array_join(F.slice("_chars", a, F.greatest(b - a, F.lit(0))), "")
    walk = F.aggregate(
        "_hits",
        F.struct(F.lit(1).alias("next"), F.lit("").alias("out")),
        lambda acc, h: F.when(
            h["_at"] >= acc["next"],
            F.struct(
                (h["_at"] - h["_neg"]).alias("next"),
                F.concat(acc["out"], between(acc["next"], h["_at"]), h["_value"]).alias("out"),
            ),
        ).otherwise(acc),
        lambda acc: F.concat(acc["out"], between(acc["next"], F.size("_chars") + 1)),
    )
    rebuilt = chars.join(hits, "_text").select("_text", walk.alias("_new"))
    return df.join(rebuilt, df[text] == rebuilt["_text"], "left").withColumn(text, F.coalesce("_new", text)).drop("_new", "_text")


def _pairs(lookup: DataFrame, inline_rows: int) -> list[tuple[str, str]] | None:
    rows = small_rows(lookup, inline_rows)
    return None if rows is None else [(r["key"], r["value"]) for r in rows]


def correct_spelling(
    df: DataFrame, row_id: str, text: str, lookup: DataFrame, inline_rows: int = INLINE_ROWS
) -> DataFrame:
    """Dictionary correction of whole words, ignoring case, simultaneous (no chaining)."""
    lookup = normal_lookup(lookup, any_case=True)
    pairs = _pairs(lookup, inline_rows)
    if pairs is not None:
        return df.withColumn(text, X.correct_words(F.col(text), pairs))
    return _replace_by_join(df, text, lookup, f"[{X.WORD_CHARS}]", any_case=True)


def correct_emoticons(
    df: DataFrame, row_id: str, text: str, lookup: DataFrame, inline_rows: int = INLINE_ROWS
) -> DataFrame:
    """Emoticons between non-word characters become words."""
    lookup = normal_lookup(lookup)
    pairs = _pairs(lookup, inline_rows)
    if pairs is not None:
        return df.withColumn(text, X.correct_emoticons(F.col(text), pairs))
    return _replace_by_join(df, text, lookup, r"\w", any_case=False)


def correct_emoji(
    df: DataFrame, row_id: str, text: str, lookup: DataFrame, inline_rows: int = INLINE_ROWS
) -> DataFrame:
    """Emoji characters and aliases become words and one blank."""
    lookup = normal_lookup(lookup)
    pairs = _pairs(lookup, inline_rows)
    if pairs is not None:
        return df.withColumn(text, X.correct_emoji(F.col(text), pairs))
    spaced = lookup.withColumn("value", F.concat("value", F.lit(" ")))
    return _replace_by_join(df, text, spaced, "", any_case=False)


def clean_text(
    df: DataFrame, row_id: str, text: str, emoticons: DataFrame, emoji: DataFrame, spelling: DataFrame
) -> DataFrame:
    """Emoticons, then emoji, then spelling."""
    df = correct_emoticons(df, row_id, text, emoticons)
    df = correct_emoji(df, row_id, text, emoji)
    return correct_spelling(df, row_id, text, spelling)


def keep_tokens(
    df: DataFrame,
    row_id: str,
    tokens: str,
    stop_words: DataFrame,
    min_length: int,
    inline_rows: int = INLINE_ROWS,
) -> DataFrame:
    """Drop short tokens and stop words from an array column, order and repeats kept."""
    long_enough = F.filter(tokens, lambda w: F.length(w) >= max(min_length, 2))
    stop_words = normal_words(stop_words)
    words = small_rows(stop_words, inline_rows)
    if words is not None:
        listed = [r["word"] for r in words]
        return df.withColumn(tokens, F.filter(long_enough, lambda w: ~F.lower(w).isin(listed)))
    # Each distinct array is worked on once, so repeated rows stay repeated.
    arrays = df.select(F.col(tokens).alias("_tokens")).where("_tokens IS NOT NULL").distinct()
    kept = (
        arrays.select("_tokens", F.posexplode(F.filter("_tokens", lambda w: F.length(w) >= max(min_length, 2))).alias("_at", "_word"))
        .join(stop_words.select(F.col("word").alias("_stop")), F.lower("_word") == F.col("_stop"), "left_anti")
        .groupBy("_tokens")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_word"))).alias("_kept"))
        .select("_tokens", F.transform("_kept", lambda k: k["_word"]).alias("_kept"))
    )
    empty = F.when(F.col(tokens).isNotNull(), F.array().cast("array<string>"))
    joined = df.join(kept, df[tokens] == kept["_tokens"], "left")
    return joined.withColumn(tokens, F.coalesce("_kept", empty)).drop("_kept", "_tokens")


def remove_stop_words(
    df: DataFrame, row_id: str, text: str, stop_words: DataFrame, inline_rows: int = INLINE_ROWS
) -> DataFrame:
    """Sentence without stop words; every surviving word is followed by a blank."""
    split = df.withColumn("_words", F.split(text, r"\s+"))
    kept = keep_tokens(split, row_id, "_words", stop_words, 2, inline_rows)
    return kept.withColumn(text, F.array_join(F.transform("_words", lambda w: F.concat(w, F.lit(" "))), "")).drop("_words")


def last_meaning(lookup: DataFrame, order: str) -> DataFrame:
    """One value per key: the last line of the file wins."""
    return last_per_key(lookup.where("key != ''"), ["key"], order)
