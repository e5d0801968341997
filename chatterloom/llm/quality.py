"""Quality by the perplexity of an interpolated modified Kneser-Ney model.

The model is one of character n-grams (``ORDER``) for each language, trained on trusted text: case, punctuation and made-up words
show in it, and the counts of all orders follow from the distinct highest n-grams. N-grams travel as 64-bit
hashes of language and characters. Counts are sharded by n-gram; totals, discounts and lower orders are joined to
them by context and suffix. Nothing is pruned or sampled.

Scoring needs, for each character, the longest known n-gram and the back-off weights above it. A model of at most
``MAX_BROADCAST`` entries (counted first; 24 bytes each) goes to all executors as a hash table; a larger one stays sharded and is
joined with the n-grams of the documents. Both ways resolve the same values.

A part of the trusted documents (by a hash of the id) is not trained on. The quantile ``KEEP`` of their perplexities, per
language, times ``SLACK``, is the threshold of that language.

Null, empty texts: no perplexity, not kept. A null language is one language. A language without trusted text has no threshold
and its documents are kept. Of several labels of one id the highest counts. Repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.shared import small_batches, stored, text_key
from chatterloom.operators.scale import broadcast_if_small

ORDER = 5
MAX_BROADCAST = 4_000_000
HELD_OUT_PARTS = 5  # one trusted document in so many sets the threshold
KEEP, SLACK = 0.99, 1.02
START = 0x110000  # above all code points
PIECE = 200  # documents that are scored at a time

_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seed(lang: str | None) -> int:
    return xxhash.xxh64_intdigest((lang or "").encode(), seed=0 if lang is None else 1)


def gram_keys(texts: list[str | None], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys [order - 1, place] of the n-grams that end at each place, the places of characters, and their texts.

    Each text follows ORDER - 1 start marks, so a place's context is the shorter n-gram at the place before.
    """
    parts, owners, seeds = [], [], []
    mark = np.full(ORDER - 1, START, np.uint32)
    for i, (text, lang) in enumerate(zip(texts, langs)):
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        parts += [mark, points]
        owners.append(np.full(len(points) + ORDER - 1, i))
        seeds.append(np.full(len(points) + ORDER - 1, _seed(lang), np.uint64))
    chars, owner, seed = np.concatenate(parts).astype(np.uint64), np.concatenate(owners), np.concatenate(seeds)
    keys = np.zeros((ORDER, len(chars)), np.uint64)
    total = seed.copy()
    for n in range(ORDER):
        total[n:] += (chars[: len(chars) - n] + np.uint64(1)) * _PRIMES[n]
        keys[n] = np.maximum(_mixed(total + np.uint64(n)), np.uint64(1))
    places = np.flatnonzero(chars != START)
    return keys, places, owner[places]


_COUNTED = ["lang string"] + [f"s{n} long" for n in range(ORDER, 0, -1)] + [f"c{n} long" for n in range(ORDER, 1, -1)]


def counts(trusted: DataFrame) -> DataFrame:
    """Distinct highest n-grams: lang, s1..s5 (keys of its suffixes), c2..c5 (their contexts) and ``a``, the count."""
    schema = pa.schema([(c.split()[0], pa.string() if c.startswith("lang") else pa.int64()) for c in _COUNTED] + [("a", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            langs, texts = x.column("lang").to_pylist(), x.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                mine = [t for t, k in zip(texts, langs) if k == lang]
                keys, places, _ = gram_keys(mine, [lang] * len(mine))
                top, first, number = np.unique(keys[ORDER - 1, places], return_index=True, return_counts=True)
                at = places[first]
                suffixes = [keys[n - 1, at] for n in range(ORDER, 0, -1)]
                contexts = [keys[n - 2, at - 1] for n in range(ORDER, 1, -1)]
                columns = [pa.array([lang] * len(top), pa.string()), *[pa.array(k.view(np.int64)) for k in suffixes + contexts], pa.array(number.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = small_batches(trusted).select("lang", "text").where(F.length("text") > 0).mapInArrow(count, ", ".join([*_COUNTED, "a long"]))
    return rows.groupBy(*[c.split()[0] for c in _COUNTED]).agg(F.sum("a").alias("a"))


def _share(a: int, column: str = "a") -> Column:
    return F.sum((F.col(column) >= a if a == 3 else F.col(column) == a).cast("long"))


def model(trusted: DataFrame) -> DataFrame:
    """(key, logp, backoff): log probability of each known n-gram and log back-off weight of each known context."""
    levels = {ORDER: stored(counts(trusted), "counts")}
    for n in range(ORDER - 1, 0, -1):  # how many different characters come before each shorter n-gram
        names = ["lang", *[f"s{k}" for k in range(n, 0, -1)], *[f"c{k}" for k in range(n, 1, -1)]]
        levels[n] = stored(levels[n + 1].groupBy(*names).agg(F.count(F.lit(1)).alias("a")), f"counts{n}")
    lower, entries = None, []
    for n in range(1, ORDER + 1):
        rows = levels[n].withColumn("ctx", F.col(f"c{n}") if n > 1 else F.lit(0).cast("long"))
        of_counts = rows.groupBy("lang").agg(*[F.sum((F.col("a") == k).cast("long")).alias(f"n{k}") for k in range(1, 5)], F.count(F.lit(1)).alias("types"))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        off = [F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.1), F.least(F.lit(k - 0.1), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(F.lit(0.5)).alias(f"d{k}") for k in (1, 2, 3)]
        discounts = of_counts.select(F.col("lang").alias("_lang"), *off, "types")
        totals = rows.groupBy("lang", "ctx").agg(F.sum("a").alias("total"), *[_share(k).alias(f"m{k}") for k in (1, 2, 3)])
        totals = totals.join(F.broadcast(discounts), F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")  # a row per language
        totals = totals.withColumn("gamma", (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total"))
        totals = totals.withColumnRenamed("lang", "_lang").withColumnRenamed("ctx", "_ctx")
        met = rows.join(totals, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("ctx") == F.col("_ctx")))
        kept = F.col("a") - F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
        if n == 1:  # an unknown character has the share of one more type
            below = 1 / (F.col("types") + 1)
        else:
            met, below = met.join(lower, f"s{n - 1}"), F.col("below")
        p = kept / F.col("total") + F.col("gamma") * below
        done = stored(met.select(F.col(f"s{n}").alias("key"), "_ctx", p.alias("p"), "gamma", "types", "lang"), f"order{n}")
        entries.append(done.select("key", F.log("p").alias("logp"), F.lit(None).cast("double").alias("backoff")))
        if n == 1:
            unknown = done.groupBy("lang").agg(F.first("gamma").alias("g"), F.first("types").alias("t"))
            # Under the context of order 0, whose key depends on the language only.
            entries.append(unknown.select(_unknown_key(F.col("lang")).alias("key"), F.log(F.col("g") / (F.col("t") + 1)).alias("logp"), F.lit(None).cast("double").alias("backoff")))
        else:
            entries.append(done.groupBy(F.col("_ctx").alias("key")).agg(F.log(F.first("gamma")).alias("backoff")).select("key", F.lit(None).cast("double").alias("logp"), "backoff"))
        lower = done.select(F.col("key").alias(f"s{n}"), F.col("p").alias("below"))
    every = entries[0]
    for e in entries[1:]:
        every = every.unionAll(e)
    return stored(every.groupBy("key").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff")), "model")


def _unknown_key(lang: Column) -> Column:
    return F.xxhash64(F.lit("unknown"), F.coalesce(lang, F.lit("")), lang.isNull())


class Table:
    """Open-addressed hash table from keys to rows of values."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray, backoff: np.ndarray):
        size = 1 << max(4, int(2 * len(keys) - 1).bit_length())
        self.mask, self.keys = np.uint64(size - 1), np.zeros(size, np.uint64)
        self.logp, self.backoff = np.full(size, np.nan, np.float32), np.zeros(size, np.float32)
        left, at = np.arange(len(keys)), keys & self.mask
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            slots, first = np.unique(at[free], return_index=True)
            put = left[free[first]]
            self.keys[slots], self.logp[slots], self.backoff[slots] = keys[put], logp[put], backoff[put]
            rest = np.ones(len(left), bool)
            rest[free[first]] = False
            left, at = left[rest], (at[rest] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logp or nan, backoff or 0)"""
        at = keys & self.mask
        there = self.keys[at]
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & self.mask
            there = self.keys[at[left]]
            left = left[(there != keys[left]) & (there != 0)]
        hit = self.keys[at] == keys
        return np.where(hit, self.logp[at], np.nan), np.where(hit, self.backoff[at], 0)


def _log_probabilities(table: Table, texts: list[str | None], langs: list[str | None], unknown: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log probabilities and number of characters of each text."""
    keys, places, owner = gram_keys(texts, langs)
    out = np.zeros(len(places))
    left = np.arange(len(places))
    for n in range(ORDER, 0, -1):
        value = table.find(keys[n - 1, places[left]])[0]
        known = ~np.isnan(value)
        out[left[known]] += value[known]
        left = left[~known]
        if not len(left):
            break
        if n > 1:
            out[left] += table.find(keys[n - 2, places[left] - 1])[1]
        else:
            of = np.array([unknown.get(k, np.nan) for k in langs])
            out[left] += of[owner[left]]
    return np.bincount(owner, out, len(texts)), np.bincount(owner, minlength=len(texts))


def _by_table(docs: DataFrame, entries: DataFrame, unknown: dict) -> DataFrame:
    found = entries.toArrow()
    keys = np.asarray(found.column("key")).view(np.uint64)
    fill = lambda c, v: np.asarray(found.column(c).fill_null(v), np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((Table(keys, fill("logp", float("nan")), fill("backoff", 0.0)), unknown))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, other = sent.value
        for x in batches:
            for i in range(0, x.num_rows, PIECE):
                y = x.slice(i, PIECE)
                total, n = _log_probabilities(table, y.column("text").to_pylist(), y.column("lang").to_pylist(), other)
                mean = np.where(n > 0, total / np.maximum(n, 1), np.nan)
                yield pa.RecordBatch.from_arrays(
                    [y.column("doc_id"), y.column("lang"), pa.array(n.astype(np.int64)), pa.array(mean, mask=np.isnan(mean))], ["doc_id", "lang", "n_chars", "mean"]
                )

    return small_batches(docs).select("doc_id", "lang", "text").mapInArrow(score, "doc_id long, lang string, n_chars long, mean double")


def _by_join(docs: DataFrame, entries: DataFrame, unknown: dict) -> DataFrame:
    """The same means with a sharded model: every n-gram and context of a place meets the model by its key."""
    own = docs.select("doc_id", "lang", "text", text_key(F.col("text")).alias("tk"))
    once = own.where(F.length("text") > 0).dropDuplicates(["doc_id", "lang", "tk"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(x.num_rows):
                y = x.slice(i, 1)
                keys, places, _ = gram_keys(y.column("text").to_pylist(), y.column("lang").to_pylist())
                for n in range(1, ORDER + 1):
                    for context in (False, True)[: 1 + (n > 1)]:
                        k = keys[n - 2, places - 1] if context else keys[n - 1, places]
                        m = len(places)
                        columns = [y.column(c).take(pa.array(np.zeros(m, np.int64))) for c in ("doc_id", "lang", "tk")]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(places), pa.array(np.full(m, n, np.int32)), pa.array(np.full(m, context)), pa.array(k.view(np.int64))], ["doc_id", "lang", "tk", "place", "n", "context", "key"])

    rows = once.mapInArrow(spread, "doc_id long, lang string, tk long, place long, n int, context boolean, key long")
    met = rows.join(entries, "key", "left")
    longest = F.max(F.when(~F.col("context") & F.col("logp").isNotNull(), F.struct("n", "logp")))
    places = met.groupBy("doc_id", "lang", "tk", "place").agg(longest.alias("best"), F.collect_list(F.when(F.col("context") & F.col("backoff").isNotNull(), F.struct("n", "backoff"))).alias("above"))
    other = F.lit(None).cast("double")
    for k, v in unknown.items():
        other = F.when(F.col("lang").eqNullSafe(F.lit(k)), F.lit(v)).otherwise(other)
    used = F.aggregate("above", F.lit(0.0), lambda acc, b: acc + F.when(b["n"] > F.coalesce(F.col("best.n"), F.lit(0)), b["backoff"]).otherwise(0.0))
    valued = places.select("doc_id", "lang", "tk", (F.coalesce("best.logp", other) + used).alias("v"))
    means = valued.groupBy(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("tk").alias("_tk")).agg(F.avg("v").alias("mean"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("tk") == F.col("_tk"))
    return own.join(means, same, "left").select("doc_id", "lang", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), "mean")


def perplexities(docs: DataFrame, entries: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity) of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), "lang", "text")
    langs = docs.select("lang").distinct().select("lang", _unknown_key(F.col("lang")).alias("key"))
    unknown = {r["lang"]: r["logp"] for r in langs.join(entries, "key").select("lang", "logp").collect()}  # a row per language
    way = _by_table if entries.count() <= max_broadcast else _by_join
    return way(docs, entries, unknown).withColumn("perplexity", F.exp(-F.col("mean"))).drop("mean")


def _held_out(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(HELD_OUT_PARTS)) == 0


def judged(docs: DataFrame, labels: DataFrame, keep: float = KEEP, slack: float = SLACK) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, threshold, kept); trusted are the documents with quality 1."""
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    training = docs.join(broadcast_if_small(trusted.where(~_held_out(F.col("_id")))), F.col("doc_id") == F.col("_id"), "left_semi")
    scored = stored(perplexities(docs, model(training)), "perplexities")
    checked = scored.join(broadcast_if_small(trusted.where(_held_out(F.col("_id")))), F.col("doc_id") == F.col("_id"), "left_semi")
    limits = checked.groupBy(F.col("lang").alias("_lang")).agg((F.percentile_approx("perplexity", keep, 10_000) * slack).alias("threshold"))
    met = scored.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")  # a row per language
    good = (F.col("n_chars") > 0) & (F.col("perplexity").isNull() | F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return met.withColumn("kept", F.coalesce(good, F.lit(False)))
