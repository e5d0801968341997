"""Benchmark decontamination: test n-grams are looked up in every window of the training text.

The distinct windows of the benchmark go to all executors as a set of hashes while they are few
(``max_broadcast``, counted first); more of them are met by a shuffled join. Hits are verified against the
words themselves, not only their hashes.

Null and empty texts have no words and no hits. Items without words have no window. An item with a null id
still marks words but is neither counted nor listed; an id that occurs twice counts once. Repeated document rows stay repeated and
get the same result. Columns other than the named ones are ignored by ``contamination``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.shared import NO_WORD, ascii_lower, let, text_key, words

WINDOW = 13
# Distinct windows that may be sent to every executor: 8 bytes each in the set, the words only to verify hits.
MAX_BROADCAST = 200_000
# Share of hit words from which a document counts as contaminated: one in so many.
HIT_SHARE = 20


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), NO_WORD)


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: (len, gram, items), gram an array of words, items the sorted distinct ids."""
    split = items.select(F.col("item_id"), item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.lit(window), F.size("w"))
    grams = split.select("item_id", length.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("at"), "w")
    grams = grams.select("item_id", "len", F.slice("w", F.col("at"), F.col("len")).alias("gram"))
    return grams.groupBy("len", "gram").agg(F.collect_set("item_id").alias("items")).select("len", "gram", "items", F.xxhash64("gram").alias("hash"))


def _gram(w: Column, at: Column, length: int) -> Column:
    return F.slice(w, at + 1, F.lit(length))


def _spans(w: Column, length: int, hashes: list[int] | None) -> Column:
    """Windows of one length as structs (at, len, gram); with ``hashes`` only those whose hash is among them."""
    last = F.size(w) - length
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.lit([]).cast("array<int>"))
    if hashes is not None:
        at = F.filter(at, lambda i: F.xxhash64(_gram(w, i, length)).isin(hashes))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"), _gram(w, i, length).alias("gram")))


def _candidates(docs: DataFrame, by_length: dict[int, list[int] | None]) -> DataFrame:
    """Windows that may be hits, one row each, and one row without for a document row that has none."""

    def found(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.concat(*[_spans(w, n, h) for n, h in sorted(by_length.items())]).alias("found"))

    scanned = docs.select("doc_id", text_key(F.col("text")).alias("key"), let(item_words(F.col("text")), found).alias("s"))
    return scanned.select("doc_id", "key", "s.n_words", F.posexplode_outer("s.found").alias("nr", "c")).select(
        "doc_id", "key", "n_words", "nr", "c.at", "c.len", "c.gram", F.xxhash64("c.gram").alias("hash")
    )


def verified_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per verified window and at least one per document row: (doc_id, key, n_words, nr, at, len, items).

    ``nr`` is 0 in the first row of each document row or null where it has no candidate; ``items`` is null
    unless the window is verified.
    """
    grams = windows(items, window)
    hashes = grams.select("len", "hash").limit(max_broadcast + 1).collect()
    if len(hashes) <= max_broadcast:
        by_length: dict[int, list[int] | None] = {}
        for row in hashes:
            by_length.setdefault(row["len"], []).append(row["hash"])
        found = _candidates(docs, by_length or {window: [0]})
        grams = F.broadcast(grams)
    else:  # every window is a row; there are at most `window` lengths
        found = _candidates(docs, {r["len"]: None for r in grams.select("len").distinct().collect()})
    return found.join(grams, ["len", "hash", "gram"], "left").select("doc_id", "key", "n_words", "nr", "at", "len", "items")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document row: doc_id, key, n_words, n_hit, items, contaminated."""
    hits = verified_hits(docs, items, window, max_broadcast)
    first = F.col("nr").isNull() | (F.col("nr") == 0)
    span = F.when(F.col("items").isNotNull(), F.struct("at", "len"))
    merged = hits.groupBy("doc_id", "key", "n_words").agg(
        F.sum(first.cast("int")).alias("copies"),
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", start, lambda acc, x: F.struct(
        (acc["n"] + F.greatest(x["at"] + x["len"] - F.greatest(acc["end"], x["at"]), F.lit(0))).alias("n"),
        F.greatest(acc["end"], x["at"] + x["len"]).alias("end")), lambda acc: acc["n"])
    counted = merged.select("doc_id", "key", "n_words", covered.alias("n_hit"), "items", "copies")
    bad = (F.col("n_hit") > 0) & (F.lit(HIT_SHARE) * F.col("n_hit") >= F.col("n_words"))
    rows = counted.withColumn("contaminated", bad).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "key", "n_words", "n_hit", "items", "contaminated")


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs.select("doc_id", "text"), items, window).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    mine = docs.withColumn("_own", text_key(F.col("text")))
    kept = mine.join(bad, (mine["_own"] == bad["_key"]) & mine["doc_id"].eqNullSafe(bad["_id"]), "left_anti")
    return kept.select(*docs.columns)


def without_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text): the normalised words of each document row that no window hits, joined by blanks."""
    hits = verified_hits(docs, items, window)
    at = F.when(F.col("items").isNotNull(), F.sequence(F.col("at"), F.col("at") + F.col("len") - 1))
    spans = hits.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_set(at))).alias("hit")).where(F.size("hit") > 0)
    hit = spans.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "hit")
    mine = docs.select("doc_id", "text", text_key(F.col("text")).alias("_own"))
    joined = mine.join(hit, (mine["_own"] == hit["_key"]) & mine["doc_id"].eqNullSafe(hit["_id"]), "left")
    cut = let(item_words(F.col("text")), lambda w: F.array_join(F.filter(w, lambda x, i: ~F.array_contains("hit", i)), " "))
    return joined.select("doc_id", F.when(F.col("hit").isNull(), F.col("text")).otherwise(cut).alias("text"))
