"""Unigram and bigram models as tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterloom.functions import fixed_values as V
from chatterloom.operators.scale import cut_lineage, lagged, loose, tight, with_entries, word_hashes

# Bytes of texts whose words and pairs are combined before they move.
COUNTED_BYTES = 16_000_000
# Characters of texts for each bucket of words and pairs.
BUCKET_CHARS = 4_000_000
# Characters of texts whose triples are combined before they move, and triples that are put together in one step.
TRIPLE_CHARS = 16_000_000
TRIPLES = 1_000_000


def unigram_counts(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Occurrences per token, case kept."""
    return tokens.groupBy(F.col(token).alias("token")).agg(F.count("*").alias("freq"))


def vocabulary(unigrams: DataFrame, cut_off: int = 1) -> DataFrame:
    """Tokens seen at least ``cut_off`` times, sorted."""
    return unigrams.where(F.col("freq") >= cut_off).select("token").orderBy("token")


def _pair_counts(pairs: DataFrame, ignore_case: bool) -> DataFrame:
    if ignore_case:
        pairs = pairs.select(F.lower("first").alias("first"), F.lower("second").alias("second"))
    return pairs.groupBy("first", "second").agg(F.count("*").alias("freq"))


def bigram_counts(df: DataFrame, tokens: str, ignore_case: bool = False) -> DataFrame:
    """Neighbouring pairs inside each token array; the first token follows the empty one.

    Pairs are made inside the row, so the only shuffle is that of combined counts.
    """
    before = F.slice(F.concat(F.array(F.lit("")), F.col(tokens)), 1, F.size(tokens))
    pairs = F.zip_with(before, tokens, lambda a, b: F.struct(a.alias("first"), b.alias("second")))
    return _pair_counts(df.select(F.inline(pairs)), ignore_case)


def bigram_counts_of_lines(
    lines: DataFrame, group: Sequence[str], pos: str, token: str, ignore_case: bool = False
) -> DataFrame:
    """The same for corpora with one token per line (``pos`` dense from 0 inside ``group``)."""
    paired = lagged(lines, group, pos, token, "", "first")
    return _pair_counts(paired.select("first", F.col(token).alias("second")), ignore_case)


def _pair_bucket(hashed: np.ndarray, first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    return (hashed[first] * np.uint64(1_000_003) + hashed[second]) % np.uint64(buckets)


def _ends(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, and behind the last one its end."""
    new = np.ones(len(sorted_keys[0]) + 1, bool)
    new[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


def _dealt(bucket: np.ndarray, columns: dict[str, pa.Array]) -> pa.Table:
    """One row per bucket; each column holds its values there, one per line, compressed."""
    order = np.argsort(bucket, kind="stable")
    at = _ends(bucket[order])
    lists = {k: pa.ListArray.from_arrays(pa.array(at, pa.int32()), v.take(pa.array(order)).cast(pa.large_string())) for k, v in columns.items()}
    joined = {k: pa.array([tight(x.as_buffer()) for x in pc.binary_join(v, pa.scalar("\n", pa.large_string()))], pa.binary()) for k, v in lists.items()}
    return pa.table({"bucket": pa.array(bucket[order][at[:-1]].astype(np.int32)), **joined})


def _values(rows: pa.Table, column: str) -> pa.Array:
    """The values of a column that was dealt out."""
    lines = pa.array([loose(c.as_py()) for c in rows.column(column)], pa.large_binary()).cast(pa.large_string())
    return pc.split_pattern(lines, "\n").flatten()


def _counts_of_block(texts: pa.Array, end: str, buckets: int) -> pa.Table:
    """Words and neighbouring pairs of a block of texts with their counts, dealt out by bucket."""
    lines = pc.split_pattern(texts, end).flatten()
    lists = pc.ascii_split_whitespace(lines)
    tokens = lists.flatten()
    kept = pc.binary_length(tokens).to_numpy() > 0
    line = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))[kept]
    encoded = tokens.filter(pa.array(kept)).dictionary_encode()
    ids = encoded.indices.to_numpy().astype(np.int64)
    words, size = encoded.dictionary, len(encoded.dictionary)
    pairs, n_pairs = np.unique((ids[:-1] * size + ids[1:])[line[:-1] == line[1:]], return_counts=True)
    first, second = (pairs // size, pairs % size) if size else (pairs, pairs)
    joined = pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second)), pa.scalar(" ", pa.large_string()))
    hashed = word_hashes(words)
    bucket = np.concatenate([hashed % np.uint64(buckets), _pair_bucket(hashed, first, second, buckets)])
    freq = pa.array(np.concatenate([np.bincount(ids, minlength=size), n_pairs])).cast(pa.string())
    return _dealt(bucket, {"word": pa.concat_arrays([words, joined]), "freq": freq})


def _counts_of_bucket(rows: pa.Table) -> pa.Table:
    found = pa.table({"word": _values(rows, "word"), "freq": _values(rows, "freq").cast(pa.int64())}).group_by("word").aggregate([("freq", "sum")])
    return pa.table({"word": found.column("word").cast(pa.string()), "freq": found.column("freq_sum")})


def word_and_pair_counts(texts: DataFrame, text: str, end: str, cleaned: Column | None = None, block: int = COUNTED_BYTES, bucket: int = BUCKET_CHARS) -> DataFrame:
    """``word, freq`` of all words and neighbouring pairs (joined by a blank), with their counts.

    Words of ``cleaned`` (``text`` as it is by default) are cut by blanks, tabs and line breaks; a pair has no ``end`` between its words. Counts are combined for blocks of about
    ``block`` bytes of texts, and move packed, one row per block and bucket of words and pairs.
    """
    size = texts.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    filled = texts.select((F.col(text) if cleaned is None else cleaned).alias("text")).where("text != ''")
    buckets = max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // bucket))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[pa.RecordBatch]:
            yield from _counts_of_block(pa.concat_arrays(waiting), end, buckets).to_batches()

        waiting, size = [], 0
        for batch in batches:
            column = batch.column(0).cast(pa.large_string())
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy())])
            start = 0
            while start < len(column):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + block - size, "right")) - 1)
                waiting.append(column.slice(start, stop - start))
                size += int(ends[stop] - ends[start])
                start = stop
                if size >= block or start < len(column):
                    yield from made()
                    waiting, size = [], 0
        if waiting:
            yield from made()

    packed = filled.mapInArrow(run, "bucket int, word binary, freq binary")
    return packed.groupBy("bucket").applyInArrow(_counts_of_bucket, "word string, freq bigint")


def total_count(unigrams: DataFrame) -> DataFrame:
    return unigrams.agg(F.sum("freq").alias("total"))


def _total(unigrams: DataFrame) -> Column:
    return total_count(unigrams).scalar()


def unigram_probability(wanted: DataFrame, unigrams: DataFrame, token: str = "token") -> DataFrame:
    """P(w) = c(w) / N, 0 for tokens never seen."""
    known = unigrams.select(F.col("token").alias(token), (F.col("freq") / _total(unigrams)).alias("prob"))
    return wanted.join(known, token, "left").withColumn("prob", F.coalesce("prob", F.lit(0.0)))


def conditional_probability(bigrams: DataFrame, unigrams: DataFrame) -> DataFrame:
    """P(second | first) = c(first, second) / c(first) for every pair whose first token is known."""
    firsts = unigrams.select(F.col("token").alias("first"), F.col("freq").alias("_n"))
    return bigrams.join(firsts, "first").select("first", "second", "freq", (F.col("freq") / F.col("_n")).alias("prob"))


def _pair_probabilities(bigrams: DataFrame, unigrams: DataFrame) -> DataFrame:
    firsts = unigrams.select(F.col("token").alias("first"), F.col("freq").alias("_n"))
    seconds = unigrams.select(F.col("token").alias("second"), (F.col("freq") / _total(unigrams)).alias("p_uni"))
    return (
        bigrams.join(firsts, "first", "left")
        .join(seconds, "second", "left")
        .select(
            "freq",
            F.coalesce(F.col("freq") / F.col("_n"), F.lit(0.0)).alias("p_cond"),
            F.coalesce("p_uni", F.lit(0.0)).alias("p_uni"),
        )
        # Pairs with equal frequency and probabilities contribute equally: keep them once, with a count.
        .groupBy("freq", "p_cond", "p_uni")
        .agg(F.count("*").alias("pairs"))
    )


def _expected(lambda1: Column | float, lambda2: Column | float) -> list[Column]:
    mixed = lambda1 * F.col("p_cond") + lambda2 * F.col("p_uni")
    mass = F.col("freq") * F.col("pairs")
    return [
        F.sum(F.when(mixed > 0, mass * lambda1 * F.col("p_cond") / mixed)).alias("c1"),
        F.sum(F.when(mixed > 0, mass * lambda2 * F.col("p_uni") / mixed)).alias("c2"),
    ]


def interpolation_round(bigrams: DataFrame, unigrams: DataFrame, lambda1: float = 0.5) -> DataFrame:
    """Weights after one EM round."""
    sums = _pair_probabilities(bigrams, unigrams).agg(*_expected(F.lit(lambda1), F.lit(1 - lambda1)))
    new = F.col("c1") / (F.col("c1") + F.col("c2"))
    return sums.select(new.alias("lambda1"), (1 - new).alias("lambda2"))


def interpolation_weights(
    bigrams: DataFrame, unigrams: DataFrame, epsilon: float = V.EM_EPSILON, rounds: int = V.EM_ROUNDS
) -> tuple[float, float, int]:
    """EM from 0.5/0.5 until the weights move by at most ``epsilon``, at most ``rounds`` rounds.

    The joined table is written once; a round is one pass that returns two sums.
    """
    table = cut_lineage(_pair_probabilities(bigrams, unigrams))
    lambda1, done = 0.5, 0
    while done < rounds:
        c1, c2 = table.agg(*_expected(F.lit(lambda1), F.lit(1 - lambda1))).first()
        moved = c1 / (c1 + c2) - lambda1
        lambda1, done = lambda1 + moved, done + 1
        if (2 * moved * moved) ** 0.5 <= epsilon:
            break
    return lambda1, 1 - lambda1, done


def pairs_starting_with(bigrams: DataFrame, first: str) -> DataFrame:
    return bigrams.where(F.col("first") == first)


def resolve_ambiguities(
    triples: DataFrame,
    probabilities: DataFrame,
    unigrams: DataFrame,
    lambda1: float = V.RESOLVER_LAMBDA1,
    lambda2: float = V.RESOLVER_LAMBDA2,
) -> DataFrame:
    """Does ``second`` belong to ``first`` or to ``third``? The second group must score strictly higher."""
    known = probabilities.select("first", "second", F.col("prob").alias("_p"))
    freq = unigrams.select(F.col("token").alias("second"), F.col("freq").alias("_u"))
    scored = known.join(freq, "second", "left").select(
        "first", "second", (F.lit(lambda1) * F.col("_p") + F.lit(lambda2) * F.coalesce("_u", F.lit(0))).alias("score")
    )
    left = scored.withColumnRenamed("score", "first_score")
    right = scored.select(F.col("first").alias("second"), F.col("second").alias("third"), F.col("score").alias("second_score"))
    joined = triples.join(left, ["first", "second"], "left").join(right, ["second", "third"], "left")
    first_score, second_score = (F.coalesce(c, F.lit(0.0)) for c in ("first_score", "second_score"))
    return joined.select("first", "second", "third", (first_score >= second_score).alias("is_first_group"))


# --- the resolver over all triples of texts -----------------------------------------------------------

# What moves: one row per block and bucket; each column holds the values of its triples, one per line, compressed.
WORDS, COUNTS = ["first", "second", "third"], ["n", "n_first", "n_second", "n_third"]


def _packed(words: pa.Array, ids: dict[str, np.ndarray], counts: dict[str, np.ndarray], by: tuple[str, str], buckets: int) -> pa.Table:
    """Triples as one row per bucket of the pair ``by``."""
    bucket = _pair_bucket(word_hashes(words), ids[by[0]], ids[by[1]], buckets)
    columns = {k: words.take(pa.array(v)) for k, v in ids.items()} | {k: pa.array(v).cast(pa.string()) for k, v in counts.items()}
    return _dealt(bucket, columns)


def _unpacked(rows: pa.Table, counts: Sequence[str]) -> tuple[pa.Array, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The words that occur (the empty one first), the triples as numbers of words, and their counts."""
    flat = [_values(rows, k) for k in WORDS]
    size = len(flat[0])
    encoded = pa.concat_arrays([pa.array([""], pa.large_string()), *flat]).dictionary_encode()
    numbers = encoded.indices.to_numpy()[1:].astype(np.int64)
    ids = {k: numbers[i * size : (i + 1) * size] for i, k in enumerate(WORDS)}
    return encoded.dictionary, ids, {k: _values(rows, k).cast(pa.int64()).to_numpy() for k in counts}


def _triples_of_block(rows: pa.Table, entries: pa.Table, buckets: int) -> pa.Table:
    """Distinct triples of a block of texts, how often each occurs, and the counts of their words.

    The empty word stands before the first and behind the last token.
    """
    lists = pc.split_pattern(pa.concat_arrays(rows.column("_line").chunks).cast(pa.large_string()), "\n")
    known = pa.concat_arrays(entries.column("word").chunks).cast(pa.large_string())
    words = pa.concat_arrays([pa.array([""], pa.large_string()), known])
    total = np.concatenate([[0], entries.column("freq").to_numpy()])
    second = pc.index_in(lists.flatten(), words).to_numpy().astype(np.int64)
    starts, ends = (np.asarray(x) for x in (lists.offsets[:-1], lists.offsets[1:]))
    first, third = np.roll(second, 1), np.roll(second, -1)
    first[starts], third[ends - 1] = 0, 0
    order = np.lexsort((third, second, first))
    ids = {k: v[order] for k, v in zip(WORDS, (first, second, third))}
    at = _ends(*ids.values())
    ids = {k: v[at[:-1]] for k, v in ids.items()}
    counts = {"n": np.diff(at)} | {f"n_{k}": total[v] for k, v in ids.items()}
    return _packed(words, ids, counts, ("first", "second"), buckets)


def _with_first_pairs(rows: pa.Table, buckets: int) -> pa.Table:
    """All triples of some first pairs, each once, beside the count of the pair; on their way to their second pairs."""
    words, ids, counts = _unpacked(rows, COUNTS)
    order = np.lexsort(tuple(ids[k] for k in reversed(WORDS)))
    ids, counts = ({k: v[order] for k, v in x.items()} for x in (ids, counts))
    pairs, at = _ends(ids["first"], ids["second"]), _ends(*ids.values())
    n_pair = np.repeat(np.add.reduceat(counts["n"], pairs[:-1]), np.diff(pairs))
    n = np.add.reduceat(counts["n"], at[:-1])
    ids, counts = {k: v[at[:-1]] for k, v in ids.items()}, {k: v[at[:-1]] for k, v in counts.items()} | {"n": n, "n_pair": n_pair[at[:-1]]}
    going = ids["third"] != 0
    ids, counts = ({k: v[going] for k, v in x.items()} for x in (ids, counts))
    return _packed(words, ids, counts, ("second", "third"), buckets)


def _with_second_pairs(rows: pa.Table, lambda1: float, lambda2: float) -> pa.Table:
    """The triples of some second pairs, resolved."""
    words, ids, counts = _unpacked(rows, [*COUNTS, "n_pair"])
    order = np.lexsort((ids["third"], ids["second"]))
    ids, counts = ({k: v[order] for k, v in x.items()} for x in (ids, counts))
    pairs = _ends(ids["second"], ids["third"])
    n_second_pair = np.repeat(np.add.reduceat(counts["n"], pairs[:-1]), np.diff(pairs))
    whole = ids["first"] != 0
    ids, counts = ({k: v[whole] for k, v in x.items()} for x in (ids, counts))
    first_score = lambda1 * (counts["n_pair"] / counts["n_first"]) + lambda2 * counts["n_second"]
    second_score = lambda1 * (n_second_pair[whole] / counts["n_second"]) + lambda2 * counts["n_third"]
    return pa.table({k: words.take(pa.array(v)).cast(pa.string()) for k, v in ids.items()} | {"is_first_group": first_score >= second_score})


def resolve_ambiguities_of_texts(
    docs: DataFrame,
    tokens: str,
    unigrams: DataFrame,
    lambda1: float = V.RESOLVER_LAMBDA1,
    lambda2: float = V.RESOLVER_LAMBDA2,
    block_chars: int = TRIPLE_CHARS,
    triples: int = TRIPLES,
) -> DataFrame:
    """``resolve_ambiguities`` for every distinct triple of neighbours in token arrays, with the pair probabilities of the same arrays.

    Tokens are not empty and hold no line break; ``unigrams`` counts them (``token, freq``). Texts meet the counts of their words in blocks, the
    triples of a block are combined there, and then move twice, packed: to the others of their first pair and to those of their second. A
    pair's count is the sum over its triples, so bigrams and their probabilities are not moved on their own. No key is a single
    word, so a frequent one is spread over all buckets.
    """
    lines = docs.select(F.array_join(tokens, "\n").alias("_line")).where("_line != ''")
    total = unigrams.agg(F.sum("freq")).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // triples))
    entries = unigrams.select(F.col("token").alias("word"), "freq")
    packed = lambda counts: T.StructType([T.StructField("bucket", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in [*WORDS, *counts]]])
    resolved = T.StructType([*[T.StructField(c, T.StringType()) for c in WORDS], T.StructField("is_first_group", T.BooleanType())])
    words = F.array_distinct(F.split("_line", "\n"))
    seen = with_entries(lines, F.length("_line"), words, entries, lambda rows, known: _triples_of_block(rows, known, buckets), packed(COUNTS), block_chars)
    left = seen.groupBy("bucket").applyInArrow(lambda rows: _with_first_pairs(rows, buckets), packed([*COUNTS, "n_pair"]))
    return left.groupBy("bucket").applyInArrow(lambda rows: _with_second_pairs(rows, lambda1, lambda2), resolved)
