"""Toxicity by a factorization machine over hashed terms.

A document is the set of its distinct words and their first letters (for inflected forms), hashed. The machine adds a weight for each term and, for each pair
of terms, the product of their factors, so that an insult together with the mention of a group can weigh more than
both alone. It is trained by AdaGrad on the ``SAMPLE_ROWS`` labelled rows with the smallest hash of the id (all, if fewer), whose
hashed terms are all that reaches the driver. Terms enter that go with the labels more than by chance, alone or, among the ``PAIR_TERMS``
most frequent ones, in a pair that tells more than both terms do separately. The model is bounded by ``BUCKETS`` and sent to all
executors; every text is scored whole.

Null, empty and blank texts have no terms and get the base rate. Rows without id or label teach nothing. Of several
labels of one id the highest counts. Without labelled rows every score is about 0. Repeated rows get equal scores. Extra columns are
passed on unchanged by ``without_toxic``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.shared import fold, small_batches

FOLDS, HELD_OUT = 4, 2
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 18
PREFIXES = (4, 5)  # inflected words share their first letters
FACTORS = 4
STEPS, BATCH = 4_000, 128
LEAST_ROWS = 5  # training rows a term must occur in
LEAST_SIGMAS = 4.0  # how far from chance a term must go with the labels; else invented and rare words are learned by heart
PAIR_TERMS = 2048  # most frequent terms whose pairs are looked at
PAIR_ROWS = 30  # training rows a pair must occur in
PAIR_SIGMAS = 6.0  # there are far more pairs than terms, so chance must be farther away
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")


class _Buckets(dict):
    """Buckets of a word and of its first letters, remembered up to a bound."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        names = [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]
        value = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names)
        if len(self) < 50_000:
            self[word] = value
        return value


_buckets_of = _Buckets()


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the words and their beginnings."""
    found = set(_WORD.findall((text or "").lower()))
    return np.unique(np.fromiter(chain.from_iterable(map(_buckets_of.__getitem__, found)), np.int32))


@dataclass
class Model:
    bias: float
    index: np.ndarray  # bucket -> row of weights; 0 for terms without one
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        known = [self.index[r] for r in rows]
        known = [k[k > 0] for k in known]
        return _probability(_forward(self, known)[0])


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(m: Model, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    v = m.factors[flat]
    sums = np.stack([np.bincount(row, v[:, k], len(rows)) for k in range(v.shape[1])], 1)
    squares = np.bincount(row, (v * v).sum(1), len(rows))
    z = m.bias + np.bincount(row, m.weights[flat], len(rows)) + 0.5 * ((sums * sums).sum(1) - squares)
    return z, sums, flat, row


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def telling_pairs(rows: list[np.ndarray], labels: np.ndarray, counts: np.ndarray, toxic: np.ndarray, rate: float) -> np.ndarray:
    """Terms with a partner beside which the labels differ from what the two terms say separately."""
    frequent = np.argsort(-counts, kind="stable")[:PAIR_TERMS]
    frequent = frequent[(counts[frequent] >= PAIR_ROWS) & (counts[frequent] < len(rows))]
    at = np.full(BUCKETS, -1, np.int32)
    at[frequent] = np.arange(len(frequent))
    both, bad = (np.zeros((len(frequent), len(frequent)), np.float32) for _ in range(2))
    for i in range(0, len(rows), 1000):
        x = np.zeros((len(rows[i : i + 1000]), len(frequent)), np.float32)
        for r, row in zip(x, rows[i : i + 1000]):
            own = at[row]
            r[own[own >= 0]] = 1
        both += x.T @ x
        y = x[labels[i : i + 1000] > 0]
        bad += y.T @ y
    single = np.clip((toxic[frequent] + rate) / (counts[frequent] + 1), 1e-4, 1 - 1e-4)
    # Terms that act on their own add up as logits.
    apart = 1 / (1 + np.exp(-(_logit(single)[:, None] + _logit(single) - _logit(np.float64(rate)))))
    far = np.abs(bad - both * apart) >= PAIR_SIGMAS * np.sqrt(np.maximum(both * apart * (1 - apart), 1))
    far &= both >= PAIR_ROWS
    # A term and its own beginning always stand together and tell nothing new.
    far &= both < np.minimum(counts[frequent][:, None], counts[frequent])
    return frequent[far.any(axis=0)]


def train(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Logistic loss, AdaGrad, and a penalty that keeps terms of few rows near zero."""
    counts = np.bincount(np.concatenate([*rows, np.empty(0, np.int32)]), minlength=BUCKETS)
    rate = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 1e-6
    toxic = np.bincount(np.concatenate([*(r for r, y in zip(rows, labels) if y), np.empty(0, np.int32)]), minlength=BUCKETS)
    telling = np.abs(toxic - counts * rate) >= LEAST_SIGMAS * np.sqrt(counts * rate * (1 - rate))
    kept = np.flatnonzero((counts >= LEAST_ROWS) & telling)
    if len(rows):
        kept = np.union1d(kept, telling_pairs(rows, labels, counts, toxic, rate))
    index = np.zeros(BUCKETS, np.int32)
    index[kept] = np.arange(1, len(kept) + 1)
    rng = np.random.default_rng(seed)
    m = Model(float(np.log(rate / (1 - rate))), index, np.zeros(len(kept) + 1), rng.normal(0, 0.02, (len(kept) + 1, FACTORS)))
    m.factors[0] = 0
    known = [k[k > 0] for k in (index[r] for r in rows)]
    seen_w, seen_v, seen_b = np.full(len(m.weights), 1e-6), np.full(m.factors.shape, 1e-6), 1e-6
    for _ in range(-(-STEPS * BATCH // len(known)) if known else 0):
        order = rng.permutation(len(known))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            z, sums, flat, row = _forward(m, [known[j] for j in part])
            g = (_probability(z) - labels[part]) / len(part)
            touched, at = np.unique(flat, return_inverse=True)
            gw = np.bincount(at, g[row], len(touched)) + 2e-4 * m.weights[touched]
            v = m.factors[flat]
            gv = np.stack([np.bincount(at, g[row] * (sums[row, k] - v[:, k]), len(touched)) for k in range(FACTORS)], 1) + 2e-3 * m.factors[touched]
            seen_w[touched] += gw * gw
            seen_v[touched] += gv * gv
            seen_b += g.sum() ** 2
            m.weights[touched] -= 0.15 * gw / np.sqrt(seen_w[touched])
            m.factors[touched] -= 0.02 * gv / np.sqrt(seen_v[touched])
            m.bias -= 0.05 * g.sum() / np.sqrt(seen_b)
    return m


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of the ``most`` labelled ids with the smallest hashes outside the held-out fold, or of all if there are no more."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    rows = usable.groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("_id"), "_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = [terms(t.as_py()) for t in x.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), x.column("toxic")], ["terms", "toxic"])

    learned = small_batches(sample(docs, labels, most)).mapInArrow(hashed, "terms array<int>, toxic boolean").toArrow()
    rows = [np.asarray(r.values, np.int32) for r in learned.column("terms")]
    order = sorted(range(len(rows)), key=lambda i: rows[i].tobytes())  # the same model however the rows arrive
    toxic = np.asarray(learned.column("toxic").to_pylist(), float)
    return train([rows[i] for i in order], toxic[order] if len(order) else toxic)


def _scored(x: pa.RecordBatch, model: Model) -> np.ndarray:
    return model.scores([terms(t.as_py()) for t in x.column("text")])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(_scored(x, sent.value))], ["doc_id", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pc.less(pa.array(_scored(x, sent.value)), threshold))

    return small_batches(docs).mapInArrow(run, docs.schema)
