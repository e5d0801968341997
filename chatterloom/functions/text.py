"""Text cleaning as native column expressions (no Python at run time)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatterloom.functions import fixed_values as V

WORD_CHARS = r"\p{L}\p{N}_"
WORD_START, WORD_END = rf"(?<![{WORD_CHARS}])", rf"(?![{WORD_CHARS}])"
SYMBOL_START, SYMBOL_END = r"(?:(?<=\W)|^)", r"(?=\W|$)"
EDGE_BLANKS = r"^[\x00-\x20]+|[\x00-\x20]+$"


def quoted(literal: str) -> str:
    """A literal inside a Java regular expression."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def trimmed(text: Column) -> Column:
    """Strip blanks and control characters from both ends."""
    return F.regexp_replace(text, EDGE_BLANKS, "")


def _replace_each(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def replace_literals(text: Column, pairs: Sequence[tuple[str, str]], before: str = "", after: str = "") -> Column:
    """Replace all keys in one left-to-right pass; the longest key wins, results are not rescanned."""
    if not pairs:
        return text
    keys = sorted({k for k, _ in pairs}, key=lambda k: (-len(k), k))
    pattern = before + "(?:" + "|".join(quoted(k) for k in keys) + ")" + after
    values = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(F.try_element_at(values, h), F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(joined, "")).otherwise(text)


def correct_words(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Whole-word dictionary correction, ignoring case, one pass without chaining.

    The text is cut into words and separators (keys of several words count as one piece). The
    ``isin`` test is a hash set, so only words that are in the dictionary pay for the map scan.
    """
    if not pairs:
        return text
    lookup = {k.lower(): v for k, v in pairs if k}
    longer = sorted((k for k in lookup if re.search(r"[^\w]", k)), key=lambda k: (-len(k), k))
    pieces = [WORD_START + "(?iu:" + "|".join(quoted(k) for k in longer) + ")" + WORD_END] if longer else []
    pieces += [rf"[{WORD_CHARS}]+", rf"[^{WORD_CHARS}]"] if longer else [rf"[{WORD_CHARS}]+", rf"[^{WORD_CHARS}]+"]
    values = F.create_map(*[F.lit(x) for pair in lookup.items() for x in pair])
    known = list(lookup)
    parts = F.regexp_extract_all(text, F.lit("|".join(pieces)), F.lit(0))
    fixed = F.transform(
        parts,
        lambda p: F.when(F.lower(p).isin(known), F.try_element_at(values, F.lower(p))).otherwise(p),
    )
    return F.array_join(fixed, "")


def compose_letters(text: Column) -> Column:
    """Decomposed Vietnamese letters to composed ones, lower and upper case."""
    pairs = V.COMPOSED_LETTERS + [(k.upper(), v.upper()) for k, v in V.COMPOSED_LETTERS]
    return F.when(text.rlike(f"[{V.TONE_MARKS}]"), _replace_each(text, pairs)).otherwise(text)


def correct_emoticons(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Emoticons that stand between non-word characters become words."""
    return replace_literals(text, pairs, SYMBOL_START, SYMBOL_END)


def correct_emoji(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Emoji characters and ``:alias:`` forms become words followed by a blank."""
    return replace_literals(text, [(k, v + " ") for k, v in pairs])


def urls_to_blank(text: Column) -> Column:
    return F.regexp_replace(text, V.URL_PATTERN, " ")


def drop_digits_and_urls(text: Column) -> Column:
    """Topic path: digits are deleted first, then links become a blank."""
    return urls_to_blank(F.regexp_replace(text, "[0-9]", ""))


def digits_to_blank(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]", " ")


def urls_and_symbols_to_blank(text: Column) -> Column:
    return F.translate(urls_to_blank(text), V.SYMBOLS_TO_BLANK, " " * len(V.SYMBOLS_TO_BLANK))


def angle_brackets_to_blank(text: Column) -> Column:
    return F.translate(text, "<>", "  ")


def is_stop_word(word: Column, stop_words: Sequence[str]) -> Column:
    return (F.length(word) < 2) | F.lower(word).isin(list(stop_words))


def without_stop_words(text: Column, stop_words: Sequence[str]) -> Column:
    """Surviving words, each followed by one blank."""
    kept = F.filter(F.split(text, r"\s+"), lambda w: ~is_stop_word(w, stop_words))
    return F.array_join(F.transform(kept, lambda w: F.concat(w, F.lit(" "))), "")


def lower_unless_caps(word: Column) -> Column:
    """Lower case, except for words typed all in upper case."""
    return F.when(word == F.upper(word), word).otherwise(F.lower(word))


def whitespace_tokens(text: Column) -> Column:
    return F.split(text, r"\s")


def move_tone_marks(text: Column) -> Column:
    return _replace_each(text, V.TONE_MARK_RULES)


def phrase_key(text: Column) -> Column:
    """First character lower-cased, tone marks moved: the form lexicon entries have."""
    return move_tone_marks(F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1)))


def drop_treebank_marks(text: Column) -> Column:
    return _replace_each(text, [(mark, "") for mark in V.TREEBANK_MARKS])


def tighten_punctuation(text: Column) -> Column:
    """No blanks before closing or after opening punctuation."""
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(text, r" ([.,!?:)\u201d])", "$1")
    return F.regexp_replace(text, r"([(\u201c]) ", "$1")


def trim_quotations(text: Column) -> Column:
    """Trim what stands between a straight double quote and the next one."""
    inside = F.transform(F.split(text, '"', -1), lambda x, i: F.when(i % 2 == 1, trimmed(x)).otherwise(x))
    return F.array_join(inside, '"')


def is_name(word: Column) -> Column:
    """One capitalised syllable, or several of which none starts in lower case."""
    syllables = F.split(word, r"\s+")
    single = (F.size(syllables) == 1) & F.element_at(syllables, 1).rlike(r"^\p{Lu}")
    return single | F.forall(syllables, lambda s: ~s.rlike(r"^\p{Ll}"))


def has_joining_punctuation(word: Column) -> Column:
    return word.rlike("[.,-]")
