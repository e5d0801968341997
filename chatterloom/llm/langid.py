"""Language identification by cross-parsing.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed greedily: the longest
match with the automaton is one phrase, then the next begins. A phrase costs the logarithm of the sample's length (a pointer
into it), so samples may differ in length; the language with the least cost for each character wins. Letters are folded to lower
case, all other characters to one blank. Frequent letters have one code, all others of the samples two or three.

The samples of all languages together hold at most ``SAMPLE_CHARS`` codes: each language has an equal part, and what short
samples leave goes to the others. So the tables (one row of next states for each state) have a set size and go to all executors.
Rows are those of the smallest hashes; of a long text a window at a hashed position is sampled. Every text is parsed whole, in blocks of ``BLOCK`` characters side by
side; a phrase ends where its block ends.

Null texts and texts without a letter are ``und`` with score 0. Ties go to the first language in code point order. Rows
without label or id teach nothing. Without labelled rows everything is ``und``. Repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.llm.shared import fold, small_batches

FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
SAMPLE_CHARS = 160_000  # in all languages together
SAMPLE_ROWS = 400  # rows per language that may be sampled
SAMPLE_LONGEST = 8_000  # characters of a text that are sampled, or few would fill a sample
LETTERS = 120  # most frequent letters that have a code of their own
DIGITS = 64  # codes of which all other letters take two or three
POINTS = 0x110000
# Added to the length of a sample in the cost of a phrase: a few characters are no evidence that phrases are cheap.
PRIOR_CHARS = 1_000
BLOCK = 1_024
SHARPNESS = 60.0  # of the score: how much a phrase in a hundred characters counts


def folded(text: str | None) -> str:
    """Lower-case letters in words parted by single blanks."""
    return " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())


def automaton(codes: list[int], letters: int) -> np.ndarray:
    """Table of next states of the suffix automaton: row 0 is unused (no match), row 1 the start."""
    follow, link, length = [None, {}], [0, 0], [0, 0]
    last = 1
    for c in codes:
        length.append(length[last] + 1), follow.append({}), link.append(0)
        new, p = len(length) - 1, last
        while p and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                length.append(length[p] + 1), follow.append(dict(follow[q])), link.append(link[q])
                copy = len(length) - 1
                while p and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.zeros((len(length), letters), np.int32)
    for state in range(1, len(length)):
        for c, to in follow[state].items():
            table[state, c] = to
    return table


@dataclass
class Letters:
    """Codes of all code points; the last code stands for letters that no sample has."""

    codes: np.ndarray  # three for each code point, of which the first ``widths`` count
    widths: np.ndarray
    size: int

    def coded(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.codes[points][np.arange(3) < self.widths[points][:, None]]


def letters_of(samples: list[str]) -> Letters:
    order = [c for c, _ in sorted(Counter("".join(samples)).items(), key=lambda x: (-x[1], x[0]))]
    frequent, others = order[:LETTERS], order[LETTERS:]
    size = len(frequent) + (DIGITS if others else 0) + 1
    codes, widths = np.full((POINTS, 3), size - 1, np.uint8), np.ones(POINTS, np.uint8)
    for i, c in enumerate(frequent):
        codes[ord(c), 0] = i
    width = 2 if len(others) <= DIGITS**2 else 3
    for i, c in enumerate(others):
        widths[ord(c)] = width
        for k in range(width):
            codes[ord(c), k] = len(frequent) + i // DIGITS**k % DIGITS
    return Letters(codes, widths, size)


def level(lengths: list[int], total: int) -> int:
    """The bound for each length with which all together stay within ``total``."""
    left = total
    for i, n in enumerate(sorted(lengths)):
        if n >= (share := left // (len(lengths) - i)):
            return max(1, share)
        left -= n
    return total


@dataclass
class Model:
    languages: list[str]
    letters: Letters
    tables: list[np.ndarray]
    costs: np.ndarray  # of a phrase in each language, 1 in the one of the longest sample

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text in each language; the texts are folded."""
        parts = [self.letters.coded(t) for t in texts]
        owner = np.repeat(np.arange(len(parts)), [-(-len(p) // BLOCK) for p in parts])
        pieces = [p[i : i + BLOCK] for p in parts for i in range(0, len(p), BLOCK)]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-size, kind="stable")
        grid = np.zeros((BLOCK, len(pieces)), np.uint8)
        for to, piece in enumerate(order):
            grid[: size[piece], to] = pieces[piece]
        alive = np.searchsorted(-size[order], -np.arange(BLOCK), side="left")  # pieces longer than each step
        counts = np.zeros((len(texts), len(self.languages)))
        for k, table in enumerate(self.tables):
            flat, width, start = table.ravel(), table.shape[1], table[1]
            state, seen = np.zeros(len(pieces), np.int64), np.ones(len(pieces), np.int64)
            for step in range(BLOCK):
                n = alive[step]
                if not n:
                    break
                c = grid[step, :n]
                if step == 0:
                    state[:n] = start[c]
                    continue
                to = flat[state[:n] * width + c]
                miss = to == 0  # the phrase ends; a letter that the sample lacks is a phrase of its own
                seen[:n] += miss
                state[:n] = np.where(miss, start[c], to)
            counts[:, k] = np.bincount(owner, seen[np.argsort(order)], len(texts)) if len(pieces) else 0
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for i in range(0, len(texts), 256):
            clean = [folded(t) for t in texts[i : i + 256]]
            if not self.languages:
                names += [UNKNOWN] * len(clean)
                scores += [0.0] * len(clean)
                continue
            rate = self.phrases(clean) / np.maximum(1, np.fromiter(map(len, clean), np.int64, len(clean)))[:, None] * self.costs
            weight = np.exp(-SHARPNESS * (rate - rate.min(axis=1, keepdims=True)))
            share = weight.max(axis=1) / weight.sum(axis=1)
            for text, best, score in zip(clean, rate.argmin(axis=1), share):
                names.append(self.languages[best] if text else UNKNOWN)
                scores.append(float(score) if text else 0.0)
        return names, scores


def train(samples: dict[str, str]) -> Model:
    """Automata over folded samples."""
    usable = {k: v for k, v in sorted(samples.items()) if v}
    if not usable:
        return Model([], letters_of([]), [], np.zeros(0))
    chars = level([len(v) for v in usable.values()], SAMPLE_CHARS)
    letters = letters_of([v[:chars] for v in usable.values()])
    coded = [letters.coded(v[:chars]) for v in usable.values()]
    bound = level([len(c) for c in coded], SAMPLE_CHARS)
    coded = [c[:bound] for c in coded]
    pointer = np.log([len(c) + PRIOR_CHARS for c in coded])
    return Model(list(usable), letters, [automaton(c.tolist(), letters.size) for c in coded], pointer / pointer.max())


def fit(docs: DataFrame, chars: int = SAMPLE_CHARS, rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled rows outside the held-out fold, per language those of the smallest hashes of the id."""
    usable = docs.where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    ).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.least(F.char_length("text"), F.lit(SAMPLE_LONGEST)).alias("n"))
    sizes = usable.groupBy("lang").count().orderBy("lang").collect()  # one row per language
    wanted = None
    for r in sizes:
        # Four times the rows that are wanted, so that the ranks below see few rows of each language and never none.
        below = -(1 << 63) + (4 * rows << 64) // max(r["count"], 4 * rows)
        mine = (F.col("lang") == r["lang"]) & (F.col("h") <= min(below, (1 << 63) - 1))
        wanted = mine if wanted is None else wanted | mine
    if wanted is None:
        return train({})
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = usable.where(wanted).withColumn("nr", rank).where(F.col("nr") <= rows)
    bound = level([r["n"] for r in chosen.groupBy("lang").agg(F.sum("n").alias("n")).collect()], chars)
    ids = chosen.select(F.col("doc_id").alias("_id")).distinct()
    found = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    room = F.greatest(F.char_length("text") - SAMPLE_LONGEST, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64("doc_id", F.lit("window")), room) + 1).cast("int")
    windows = found.select("lang", F.substring("text", start, F.lit(SAMPLE_LONGEST)).alias("text"), F.xxhash64("doc_id").alias("h"))
    samples: dict[str, list[str]] = {}
    for r in windows.orderBy("lang", "h", "text").toLocalIterator():
        held = samples.setdefault(r["lang"], [])
        if sum(map(len, held)) < bound:
            held.append(folded(r["text"]))
    return train({k: " ".join(v) for k, v in samples.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            names, scores = sent.value.predict(x.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
