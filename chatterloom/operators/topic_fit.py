"""Expectation maximisation for topic models of several sizes side by side.

Documents are packed into blocks, the topics of all models are columns of one matrix. A pass reads each block once and updates every
model: an entry's share of a topic is its term's row times its document's row, normalised within each model. Sums per (term, column) are combined
in the task before they move. Terms that occur in one block only never move: their sums are kept beside the block, and only the totals of
such sums leave the task. The matrix of the other terms is cut into shards; it is sent to all tasks while it has at most
``SENT_CELLS`` cells, otherwise each block receives the rows of its shared terms by a join on the shard. Both ways run the same arithmetic.

Where the matrix of all models has more cells, models are fitted in groups, one group after the other, each of as many models as are sent together
and of one at least. A pass is written aside and the one before it is removed, so two passes of one group and the best group so far are all
that lies on disk, however many passes there are.

The start depends on contents only, so results don't depend on partitions; documents with equal bags get equal weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.operators.scale import cut_lineage, discard, loose, shuffles_end, tight

# Cells of a term matrix that is sent to all tasks: 64 MB of doubles.
SENT_CELLS = 8_000_000
# Entries of a block, unless one document alone has more.
BLOCK_ENTRIES = 50_000
# Concentration of terms, above which a topic's smoothing adds nothing.
TERM_PRIOR = 1.1

# Shard of the totals of sums that stay in their blocks.
STAYED = -1

# ``own``: terms that occur in no other block; ``kept``: their sums.
BLOCK = "block long, uid binary, seed binary, size binary, idx binary, n binary, own binary"
PASS = f"{BLOCK}, state binary, kept binary, shard long, at binary, sums binary"


@dataclass(frozen=True)
class Models:
    """Columns of all models: where each begins, and the priors of its documents."""

    ks: tuple[int, ...]
    terms: int
    seed: int
    shard: int = 2048  # terms of a shard
    before: int = 0  # columns of the models before these ones, if these are a group of them

    def groups(self, reach: int) -> list[Models]:
        """Neighbouring models whose matrix of ``reach`` terms is sent to all tasks; at least one model each."""
        ks: list[list[int]] = []
        for k in self.ks:
            if not ks or reach * (sum(ks[-1]) + k) > SENT_CELLS:
                ks.append([])
            ks[-1].append(k)
        before = np.concatenate([[0], np.cumsum([sum(x) for x in ks])]).tolist()
        return [replace(self, ks=tuple(x), before=self.before + b) for x, b in zip(ks, before)]

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.ks)[:-1]]).astype(int)

    @property
    def columns(self) -> int:
        return sum(self.ks)

    def spread(self, per_model: np.ndarray) -> np.ndarray:
        return np.repeat(per_model, self.ks, axis=-1)

    @property
    def document_prior(self) -> np.ndarray:
        """50/k + 1 for each topic of a model with k topics, less one."""
        return self.spread(50.0 / np.array(self.ks))

    def per_model(self, x: np.ndarray) -> np.ndarray:
        """Sums of the columns of each model."""
        return x @ (np.repeat(np.arange(len(self.ks)), self.ks)[:, None] == np.arange(len(self.ks))).astype(float)

    def normal(self, x: np.ndarray) -> np.ndarray:
        """Rows with sum one within each model; equal shares where a model has none."""
        total = self.per_model(x)
        if (total > 0).all():
            return x / self.spread(total)
        total = self.spread(total)
        return np.where(total > 0, x / np.where(total > 0, total, 1), 1 / self.spread(np.array(self.ks, float)))


def _uniform(key: np.ndarray) -> np.ndarray:
    """In (0, 1), from a 64-bit key."""
    key = (key ^ (key >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    key = (key ^ (key >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((key ^ (key >> np.uint64(33))) >> np.uint64(11)).astype(float) / float(1 << 53) + 2.0**-54


class Bags:
    """The documents of one block."""

    def __init__(self, row: dict) -> None:
        self.row = row
        kinds = {"uid": np.int64, "seed": np.int64, "size": np.int64, "idx": np.int64, "n": np.float64}
        self.uid, self.seed, self.size, self.idx, self.n = (np.frombuffer(row[c], k) for c, k in kinds.items())
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.terms, self.at = np.unique(self.idx, return_inverse=True)
        self.stays = np.isin(self.terms, np.frombuffer(row.get("own") or b"", np.int64), assume_unique=True)

    def all_sums(self, shared: np.ndarray) -> np.ndarray:
        """Sums of all ``terms``, from those of the shared ones."""
        sums = np.empty((len(self.terms), shared.shape[1]))
        sums[~self.stays] = shared
        if self.stays.any():
            sums[self.stays] = np.frombuffer(self.row["kept"]).reshape(-1, shared.shape[1])
        return sums

    def start(self, m: Models) -> np.ndarray:
        """A random share of each entry for every topic."""
        keys = self.seed[self.doc].astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + self.idx.astype(np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)
        return m.normal(_uniform(keys + (np.arange(m.before, m.before + m.columns, dtype=np.uint64) + np.uint64(m.seed * 1_000_003 + 1)) * np.uint64(0x165667B19E3779F9)))

    def updated(self, m: Models, weights: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums per document and per term of each entry's new shares; ``weights`` holds a row for each of ``terms``.

        An entry's share of a topic is its term's row times its document's row, normalised within each model. Columns are worked
        on one by one, so that what is read stays near the processor.
        """
        of_terms, of_documents = np.ascontiguousarray(weights.T), np.ascontiguousarray((state + m.document_prior).T)
        documents, terms = np.zeros((m.columns, len(self.size))), np.zeros((m.columns, len(self.terms)))
        for first, k in zip(m.starts.tolist(), m.ks):
            parts = [of_terms[c][self.at] * of_documents[c][self.doc] for c in range(first, first + k)]
            total = parts[0].copy()
            for part in parts[1:]:
                total += part
            nothing = ~(total > 0)
            if nothing.any():
                total[nothing] = k
                for part in parts:
                    part[nothing] = 1
            whole = self.n / total
            for c, part in enumerate(parts, first):
                part *= whole
                documents[c] = np.bincount(self.doc, part, len(self.size))
                terms[c] = np.bincount(self.at, part, len(self.terms))
        return documents.T, terms.T

    def summed(self, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the entries' shares per document and per term."""
        whole = shares * self.n[:, None]
        documents = np.zeros((len(self.size), whole.shape[1]))
        if not len(whole):
            return documents, np.zeros((0, whole.shape[1]))
        filled = np.flatnonzero(self.size)
        documents[filled] = np.add.reduceat(whole, np.cumsum(self.size)[filled] - self.size[filled], axis=0)
        order = np.argsort(self.at, kind="stable")
        first = np.searchsorted(self.at[order], np.arange(len(self.terms)))
        return documents, np.add.reduceat(whole[order], first, axis=0)

    def log_likelihood(self, m: Models, weights: np.ndarray, state: np.ndarray) -> np.ndarray:
        of_terms, theta = np.ascontiguousarray(weights.T), np.ascontiguousarray(m.normal(state + m.document_prior).T)
        fits = [sum(of_terms[c][self.at] * theta[c][self.doc] for c in range(first, first + k)) for first, k in zip(m.starts.tolist(), m.ks)]
        return np.array([(self.n * np.log(fit)).sum() for fit in fits])


def _bags(row: dict) -> Bags:
    """The documents of a block whose entries are compressed; they are passed on as they are."""
    bags = Bags(row | {c: loose(row[c]) for c in ("idx", "n")})
    bags.row = row
    return bags


def smoothed(m: Models, sums: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Probability of terms under each topic from their sums and the totals of the topics."""
    return (sums + TERM_PRIOR - 1) / (totals + m.terms * (TERM_PRIOR - 1))


def blocks_of(bags: DataFrame) -> DataFrame:
    """(uid, seed, idx, n) packed into blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            size = np.array([len(i) for i in x.column("idx").to_pylist()], np.int64)
            piece = np.cumsum(size) // BLOCK_ENTRIES
            for p in np.unique(piece):
                rows = np.flatnonzero(piece == p)
                part = x.slice(int(rows[0]), len(rows))
                uid = part.column("uid").to_numpy()
                whole = [uid, part.column("seed").to_numpy(), size[rows], part.column("idx").flatten().to_numpy().astype(np.int64), part.column("n").flatten().to_numpy().astype(float)]
                columns = [pa.array([int(uid[0])]), *(pa.array([c.tobytes()], pa.binary()) for c in whole), pa.nulls(1, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCK.split(", ")])

    return bags.select("uid", "seed", "idx", "n").mapInArrow(pack, BLOCK)


def tight_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with compressed entries: they are written again with every pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in BLOCK.split(", ")]
        for x in batches:
            for r in x.to_pylist():
                made = r | {c: tight(r[c]) for c in ("idx", "n")} | {"own": np.array(r["own"] or [], np.int64).tobytes()}
                yield pa.RecordBatch.from_arrays([pa.array([made[c]], pa.int64() if c == "block" else pa.binary()) for c in names], names)

    return blocks.mapInArrow(run, BLOCK)


def with_own_terms(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Blocks with the terms (``own``) that occur in no other one, and how far the indexes of shared terms reach."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in x.to_pylist():
                terms = np.unique(np.frombuffer(r["idx"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.full(len(terms), r["block"]))], ["term", "block"])

    terms = blocks.select("block", "idx").mapInArrow(told, "term long, block long")
    seen = cut_lineage(terms.groupBy("term").agg(F.min("block").alias("first"), F.max("block").alias("last")))
    reach = seen.where("first < last").agg(F.max("term")).first()[0]
    # No more terms than the block has entries.
    own = seen.where("first = last").groupBy(F.col("first").alias("_block")).agg(F.array_sort(F.collect_list("term")).alias("own"))
    beside = blocks.drop("own").join(own, blocks["block"] == F.col("_block"), "left").drop("_block")
    return beside, 0 if reach is None else reach + 1


class TermRows:
    """The term matrix after a pass: sent whole while small, else joined to the blocks.

    ``reach``: no term of a higher index has rows here, as such terms stay in their blocks. ``m``: all models of the search, of which the
    columns of the group ``held`` are here.
    """

    def __init__(self, held: Models, passed: DataFrame, reach: int | None = None, m: Models | None = None) -> None:
        self.m, self.held, columns, shard = m or held, held, held.columns, held.shard
        m = held
        reach = m.terms if reach is None else reach
        self.sent = None
        parts = passed.where("shard IS NOT NULL").select("shard", "at", "sums")

        def add(t: pa.Table) -> pa.Table:
            total = np.zeros((shard, columns))
            for at, sums in zip(t.column("at").to_pylist(), t.column("sums").to_pylist()):
                total[np.frombuffer(at, np.int64)] += np.frombuffer(sums).reshape(-1, columns)
            return pa.table({"shard": t.column("shard").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary()), "totals": pa.array([total.sum(axis=0).tolist()], pa.list_(pa.float64()))})

        self.table = parts.groupBy("shard").applyInArrow(add, "shard long, sums binary, totals array<double>")
        self.matrix, self.cut = None, False
        if reach * columns <= SENT_CELLS:
            self.matrix, stayed = np.zeros((-(-reach // shard) * shard, columns)), 0.0
            with shuffles_end(passed.sparkSession):
                found = self.table.select("shard", "sums").toArrow()
            for at, sums in zip(found.column("shard").to_pylist(), found.column("sums")):
                rows = np.frombuffer(sums.as_buffer()).reshape(-1, columns)
                if at == STAYED:
                    stayed = rows[0]
                else:
                    self.matrix[at * shard : (at + 1) * shard] = rows
            self.totals = self.matrix.sum(axis=0) + stayed
        else:
            self.table, self.cut = cut_lineage(self.table), True
            found = self.table.select(F.posexplode("totals").alias("c", "x")).groupBy("c").agg(F.sum("x").alias("x")).collect()
            self.totals = np.array([r["x"] for r in sorted(found)])

    def totals_of(self, k: int) -> list[float]:
        """Totals of the topics of one model."""
        first = int(self.held.starts[self.held.ks.index(k)])
        return self.totals[first : first + k].tolist()

    def release(self) -> None:
        """Called when what was made of the matrix has been written: neither the sent copies nor the table are left."""
        if self.sent is not None:
            self.sent.destroy()
            self.sent = None
        if self.cut:
            discard(self.table)

    def run(self, blocks: DataFrame, work: Callable[[Iterator[tuple[Bags, np.ndarray, bytes | None]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``work`` over (bags, probabilities of their terms, state) of all blocks."""
        m, totals = self.held, self.totals
        if self.matrix is not None:
            sent = self.sent = blocks.sparkSession.sparkContext.broadcast(self.matrix)

            def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                bags = ((_bags(r), r["state"]) for x in batches for r in x.to_pylist())
                return work((b, smoothed(m, b.all_sums(sent.value[b.terms[~b.stays]]), totals), state) for b, state in bags)

            return blocks.mapInArrow(rows, schema)

        def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for r in x.to_pylist():
                    terms = np.setdiff1d(np.frombuffer(loose(r["idx"]), np.int64), np.frombuffer(r["own"] or b"", np.int64))
                    shards = np.unique(terms // m.shard)
                    at = [(terms[terms // m.shard == s] % m.shard).tobytes() for s in shards]
                    yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array([r["block"]] * len(shards), pa.int64()), pa.array(at, pa.binary())], ["shard", "block", "at"])

        columns = m.columns

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                own = [np.frombuffer(s).reshape(-1, columns)[np.frombuffer(a, np.int64)].tobytes() for s, a in zip(x.column("sums").to_pylist(), x.column("at").to_pylist())]
                yield pa.RecordBatch.from_arrays([x.column("block"), x.column("shard"), pa.array(own, pa.binary())], ["block", "shard", "sums"])

        picked = blocks.select("block", "idx", "own").mapInArrow(needed, "shard long, block long, at binary").join(self.table.select("shard", "sums"), "shard").mapInArrow(pick, "block long, shard long, sums binary")
        # No more rows than the block has shards of terms.
        beside = picked.groupBy(F.col("block").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("shard", "sums"))).alias("rows"))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def each() -> Iterator[tuple[Bags, np.ndarray, bytes | None]]:
                for x in batches:
                    for r in x.to_pylist():
                        sums = np.frombuffer(b"".join(p["sums"] for p in r["rows"] or [])).reshape(-1, columns)
                        bags = _bags(r)
                        yield bags, smoothed(m, bags.all_sums(sums), totals), r["state"]

            return work(each())

        return blocks.join(beside, blocks["block"] == F.col("_block"), "left").drop("_block").mapInArrow(joined, schema)


def _emitted(m: Models, passed: Iterator[tuple[Bags, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Blocks with new states and the sums that stay there, then what the task has summed per shard of the other terms."""
    names = [c.split()[0] for c in PASS.split(", ")]
    sums: dict[int, np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for shard in sorted(sums):
            used = np.flatnonzero(sums[shard].any(axis=1))
            nothing = [pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.binary()) for _ in range(8))]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([shard]), pa.array([used.tobytes()], pa.binary()), pa.array([sums[shard][used].tobytes()], pa.binary())], names)
        sums.clear()

    for bags, state, terms in passed:
        kept, moved, shared = terms[bags.stays], terms[~bags.stays], bags.terms[~bags.stays]
        shards, first = np.unique(shared // m.shard, return_index=True)  # terms ascend
        for shard, a, b in zip(shards.tolist(), first, [*first[1:], len(shared)]):
            if shard not in sums:
                sums[shard] = np.zeros((m.shard, m.columns))
            sums[shard][shared[a:b] % m.shard] += moved[a:b]
        if len(kept):
            sums.setdefault(STAYED, np.zeros((1, m.columns)))[0] += kept.sum(axis=0)
        same = [pa.array([bags.row[c]], pa.int64() if c == "block" else pa.binary()) for c in names[:7]]
        own = [pa.array([x.tobytes()], pa.binary()) for x in (state, kept)]
        yield pa.RecordBatch.from_arrays([*same, *own, pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], names)
        if len(sums) * m.shard * m.columns > SENT_CELLS:
            yield from told()
    yield from told()


def _states(passed: DataFrame) -> DataFrame:
    return passed.where("shard IS NULL").drop("shard", "at", "sums")


def _whole_parts(m: Models, passed: DataFrame) -> DataFrame:
    """The shard rows of a pass with those of the terms that stay in their blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in x.to_pylist():
                own, kept = np.frombuffer(r["own"], np.int64), np.frombuffer(r["kept"]).reshape(-1, m.columns)
                shards, first = np.unique(own // m.shard, return_index=True)
                spans = list(zip(first, [*first[1:], len(own)]))
                at, sums = ([f(a, b).tobytes() for a, b in spans] for f in (lambda a, b: own[a:b] % m.shard, lambda a, b: kept[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(at, pa.binary()), pa.array(sums, pa.binary())], ["shard", "at", "sums"])

    moved = passed.where(F.col("shard") != STAYED).select("shard", "at", "sums")
    return moved.unionByName(passed.where("shard IS NULL").select("own", "kept").mapInArrow(read, "shard long, at binary, sums binary"))


def _fit_group(blocks: DataFrame, m: Models, reach: int, iterations: int) -> tuple[DataFrame, TermRows, dict[int, float]]:
    """The last pass over the blocks, the shared terms after it and the log-likelihood by k."""
    columns = m.columns

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emitted(m, ((b, *b.summed(b.start(m))) for x in batches for b in map(_bags, x.to_pylist())))

    def step(rows: Iterator[tuple[Bags, np.ndarray, bytes | None]]) -> Iterator[pa.RecordBatch]:
        return _emitted(m, ((b, *b.updated(m, weights, np.frombuffer(state).reshape(-1, columns))) for b, weights, state in rows))

    def judge(rows: Iterator[tuple[Bags, np.ndarray, bytes | None]]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(m.ks))
        for b, weights, state in rows:
            total += b.log_likelihood(m, weights, np.frombuffer(state).reshape(-1, columns))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["model", "ll"])

    passed = cut_lineage(blocks.mapInArrow(start, PASS))
    terms = TermRows(m, passed, reach)
    for _ in range(iterations):
        before, passed = passed, cut_lineage(terms.run(_states(passed), step, PASS))
        discard(before)
        terms.release()
        terms = TermRows(m, passed, reach)
    with shuffles_end(blocks.sparkSession):
        found = terms.run(_states(passed), judge, "model int, ll double").groupBy("model").agg(F.sum("ll").alias("ll")).collect()
    terms.release()
    return passed, terms, {m.ks[r["model"]]: r["ll"] for r in found}


def fit_all(bags: DataFrame, m: Models, iterations: int) -> tuple[DataFrame, TermRows, dict[int, float], dict[int, float]]:
    """After so many passes over (uid, seed, idx, n): blocks with their states and the term matrix of the group of models with the
    highest log-likelihood, then the log-likelihood and the sum of all shares by k.
    """
    whole = cut_lineage(blocks_of(bags))
    # A few more tasks than cores would take twice as long.
    cores, tasks = bags.sparkSession.sparkContext.defaultParallelism, whole.rdd.getNumPartitions()
    tasks = cores if tasks < 2 * cores else tasks
    beside, reach = with_own_terms(whole)
    blocks = cut_lineage(tight_blocks(beside.repartition(tasks)))
    discard(whole)
    best, scores, masses = None, {}, {}
    for group in m.groups(reach):
        passed, terms, found = _fit_group(blocks, group, reach, iterations)
        scores |= found
        masses |= dict(zip(group.ks, group.per_model(terms.totals[None, :])[0].tolist()))
        first = min(group.ks, key=lambda k: (-scores.get(k, 0.0), k))
        if best is not None and (-scores.get(first, 0.0), first) >= best[0]:
            discard(passed)
            continue
        if best is not None:
            discard(best[2])
        best = (-scores.get(first, 0.0), first), group, passed
    discard(blocks)
    _, group, passed = best
    return _states(passed), TermRows(group, _whole_parts(group, passed), m=m), scores, masses


def document_rows(blocks: DataFrame, m: Models, only: int) -> DataFrame:
    """(uid, weights) of the model with ``only`` topics, from the states of the blocks."""
    first = int(m.starts[m.ks.index(only)])
    one = Models((only,), m.terms, m.seed, m.shard)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in x.to_pylist():
                state = np.frombuffer(r["state"]).reshape(-1, m.columns)[:, first : first + only]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["uid"], np.int64)), pa.array(one.normal(state).tolist(), pa.list_(pa.float64()))], ["uid", "weights"])

    return blocks.mapInArrow(read, "uid long, weights array<double>")


def term_rows(terms: TermRows, only: int) -> DataFrame:
    """(idx, weights): each term's share of the topics of one model."""
    m = terms.held
    first = int(m.starts[m.ks.index(only)])
    totals = np.array(terms.totals_of(only))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in x.to_pylist():
                own = np.frombuffer(r["sums"]).reshape(-1, m.columns)[:, first : first + only]
                idx = r["shard"] * m.shard + np.arange(len(own))
                kept = idx < m.terms
                yield pa.RecordBatch.from_arrays([pa.array(idx[kept]), pa.array((own / totals)[kept].tolist(), pa.list_(pa.float64()))], ["idx", "weights"])

    return terms.table.mapInArrow(read, "idx long, weights array<double>")


def folded_in(bags: DataFrame, terms: TermRows, only: int, rounds: int) -> DataFrame:
    """(uid, weights) of documents under a fitted model whose terms stay as they are."""
    m = terms.held
    first = int(m.starts[m.ks.index(only)])
    one = Models((only,), m.terms, m.seed, m.shard)

    def work(rows: Iterator[tuple[Bags, np.ndarray, bytes | None]]) -> Iterator[pa.RecordBatch]:
        for b, weights, _ in rows:
            own = weights[:, first : first + only]
            state = np.zeros((len(b.size), only))
            for _ in range(rounds):
                state, _ = b.updated(one, own, state)
            yield pa.RecordBatch.from_arrays([pa.array(b.uid), pa.array(one.normal(state).tolist(), pa.list_(pa.float64()))], ["uid", "weights"])

    return terms.run(tight_blocks(blocks_of(bags)).withColumns({c: F.lit(None).cast("binary") for c in ("state", "kept")}), work, "uid long, weights array<double>")
