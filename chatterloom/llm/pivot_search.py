"""Exact search of the largest inner products by elimination over a table of pivot distances.

The distances of every vector to ``PIVOTS`` pivots are computed once. For a query and a candidate the largest difference of their distances
to a pivot bounds their own distance from below, and with both lengths known that bounds their inner product from above:
``2 <q, v> = |q|^2 + |v|^2 - d(q, v)^2``. Candidates whose bound falls below what the query has already are gone. Those left are scored in
the order of their bounds, in a few growing portions, until no bound reaches the query's k-th score. Scores are whole numbers, exact in the
float or integer type that holds the largest of the block; bounds give way by ``SLACK``, and equal scores are always looked at.

Vectors are packed into blocks of ``BLOCK_ROWS``. Each query starts with the k-th score among a sample of ``SAMPLE`` vectors, a score that the
result can't fall below. Blocks of queries (hash buckets of about ``QUERY_ROWS``) meet each block of
candidates in an equi-join on the bucket; only k rows of each query and block leave a task. Few buckets are broadcast after counting them.

Vectors that are null or hold a null or non-finite component take no part. Vectors of other lengths are compared as if zeros followed. A
query's own row is no candidate; other rows with its id are. Rows without an id are no queries; as candidates they come last among
equals. Repeated rows count by themselves. Empty tables give no rows; extra columns are ignored. The
driver sees the sample only. Components too large for exact scores end the job with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.llm.shared import stored
from chatterloom.llm.simplex import whole_vectors

PIVOTS = 32
SAMPLE = 1024
BLOCK_ROWS = 8192
QUERY_ROWS = 128
# Queries whose bounds are computed together.
TOGETHER = 32
# Candidates of each portion in the order of bounds; what can't be excluded then is scored together.
PORTIONS = (64, 512)
# Buckets of queries that may be broadcast.
BROADCAST_BUCKETS = 32
SLACK = 1e-5
LARGEST_SQUARE = 2.0**62
NOTHING = np.iinfo(np.int64).min


class Block:
    """Vectors as one zero-filled matrix, with row keys, ids and distances to the pivots."""

    def __init__(self, uid: list[int], vec_id: list[int | None], vectors: list, pivots: np.ndarray | None, table: np.ndarray | None = None) -> None:
        self.uid = np.array(uid, dtype=np.int64)
        self.null = np.array([i is None for i in vec_id], dtype=bool)
        self.vec_id = np.array([0 if i is None else i for i in vec_id], dtype=np.int64)
        self.v = np.zeros((len(vectors), max(map(len, vectors), default=0)), dtype=np.int64)
        for row, x in zip(self.v, vectors):
            row[: len(x)] = x
        self.square = (self.v.astype(float) ** 2).sum(axis=1)
        if (self.square >= LARGEST_SQUARE).any():
            raise OverflowError("components too large for exact scores")
        self.table = self._distances(pivots) if table is None else table

    def _distances(self, pivots: np.ndarray) -> np.ndarray:
        n = min(self.v.shape[1], pivots.shape[1])
        inner = self.v[:, :n].astype(float) @ pivots[:, :n].astype(float).T
        return np.sqrt(np.maximum(self.square[:, None] + (pivots.astype(float) ** 2).sum(axis=1) - 2 * inner, 0))

    def exact(self, largest: float) -> np.ndarray:
        """The vectors in a type in which products with vectors of at most that squared length are whole numbers."""
        most = np.sqrt(largest * self.square.max(initial=0))
        return self.v.astype(np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64)

    def bounds(self, others: Block, rows: slice) -> np.ndarray:
        """Upper bounds of the products of some vectors of ``others`` with all vectors, one row for each."""
        low = np.zeros((len(others.square[rows]), len(self.square)), np.float32)
        own, asked = self.table.astype(np.float32).T, others.table[rows].astype(np.float32)
        apart = np.empty_like(low)
        for p in range(own.shape[0]):
            np.subtract(own[p], asked[:, p : p + 1], out=apart)
            np.abs(apart, out=apart)
            np.maximum(low, apart, out=low)
        total = self.square + others.square[rows, None]
        return (total - low.astype(float) ** 2 + SLACK * (total + 1)) / 2


def spread_out(vectors: list[list[int]], most: int = PIVOTS) -> np.ndarray:
    """Pivots: each the vector farthest from those before it."""
    block = Block(list(range(len(vectors))), [None] * len(vectors), vectors, np.zeros((0, 0), np.int64))
    chosen = [int(block.square.argmax())] if vectors else []
    far = np.full(len(vectors), np.inf)
    while chosen and len(chosen) < most:
        far = np.minimum(far, ((block.v - block.v[chosen[-1]]).astype(float) ** 2).sum(axis=1))
        if far.max() == 0:
            break
        chosen.append(int(far.argmax()))
    return block.v[chosen]


def best_of(block: Block, bound: np.ndarray, v: np.ndarray, uid: int, q: np.ndarray, k: int, least: int = NOTHING) -> tuple[list, int]:
    """The best ``k`` (score, null, id) of a block with scores of at least ``least``, and how many candidates were scored.

    ``v`` holds the vectors of the block in the type that is exact here.
    """
    rows = np.flatnonzero((bound >= least) & (block.uid != uid))
    n = min(v.shape[1], len(q))
    v, q = v[:, :n], q[:n].astype(v.dtype)
    top, seen = [], 0

    def add(part: np.ndarray, scores: np.ndarray) -> None:
        nonlocal top, seen, least
        seen += len(part)
        good = scores >= least
        part, scores = part[good], scores[good]
        if len(part) > k:  # what is below the k-th of this portion can't be among the best
            good = scores >= np.partition(scores, -k)[-k]
            part, scores = part[good], scores[good]
        found = zip(map(int, scores), block.null[part].tolist(), block.vec_id[part].tolist())
        top = sorted([*top, *found], key=lambda x: (-x[0], x[1], x[2]))[:k]
        if len(top) == k:
            least = max(least, top[-1][0])

    for size in PORTIONS:
        if not len(rows):
            break
        best = np.argpartition(-bound[rows], size)[:size] if size < len(rows) else np.arange(len(rows))
        part = rows[best]
        add(part, v[part] @ q)
        rows = np.delete(rows, best)
        rows = rows[bound[rows] >= least]
    if len(rows):
        # Bounds that tell so little leave most of a block: one product with all of it is cheaper than to pick rows.
        add(rows, (v @ q)[rows])
    return top, seen


def best_of_all(block: Block, asked: Block, k: int, least: list[int] | None = None) -> Iterator[tuple[list, int]]:
    """``best_of`` for each vector of ``asked``."""
    v = block.exact(asked.square.max(initial=0))
    for start in range(0, len(asked.uid), TOGETHER):
        rows = slice(start, start + TOGETHER)
        for i, bound in enumerate(block.bounds(asked, rows), start):
            yield best_of(block, bound, v, asked.uid[i], asked.v[i], k, NOTHING if least is None else least[i])


def _packed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """One row for each block of vectors: its columns as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, BLOCK_ROWS):
                part = x.slice(at, BLOCK_ROWS)
                b = Block(part.column("uid").to_pylist(), part.column("vec_id").to_pylist(), part.column("v").to_pylist(), pivots)
                columns = [b.uid, b.null, b.vec_id, b.v.astype(np.int32), b.square, b.table]
                yield pa.RecordBatch.from_arrays([pa.array([len(b.uid)]), pa.array([[c.tobytes() for c in columns]], pa.list_(pa.binary()))], ["n", "columns"])

    return vectors.mapInArrow(pack, "n long, columns array<binary>")


def _unpacked(n: int, columns: list[bytes]) -> Block:
    b = Block.__new__(Block)
    uid, null, vec_id, v, square, table = columns
    b.uid, b.null, b.vec_id, b.square = np.frombuffer(uid, np.int64), np.frombuffer(null, bool), np.frombuffer(vec_id, np.int64), np.frombuffer(square)
    b.v = np.frombuffer(v, np.int32).reshape(n, len(v) // (4 * n)).astype(np.int64)
    b.table = np.frombuffer(table).reshape(n, len(table) // (8 * n))
    return b


def _started(queries: DataFrame, sample: Block, pivots: np.ndarray, k: int, buckets: int) -> DataFrame:
    """Queries with their bucket, and the k-th score they have among the sample."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            b = Block(x.column("uid").to_pylist(), x.column("vec_id").to_pylist(), x.column("v").to_pylist(), pivots)
            least = [top[-1][0] if len(top) == k else NOTHING for top, _ in best_of_all(sample, b, k)]
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("uid", "vec_id", "v")), pa.array(least, pa.int64())], ["uid", "vec_id", "v", "least"])

    made = queries.mapInArrow(start, "uid long, vec_id long, v array<long>, least long")
    return made.groupBy(F.pmod(F.xxhash64("uid"), F.lit(buckets)).alias("bucket")).agg(F.collect_list(F.struct("uid", "vec_id", "v", "least")).alias("queries"))


def _met(pairs: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """The best rows of each pair of blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for n, columns, asked in zip(x.column("n").to_pylist(), x.column("columns"), x.column("queries")):
                block, asked = _unpacked(n, columns.as_py()), asked.as_py()
                q = Block([a["uid"] for a in asked], [a["vec_id"] for a in asked], [a["v"] for a in asked], pivots)
                out = []
                for a, (top, _) in zip(asked, best_of_all(block, q, k, [a["least"] for a in asked])):
                    out += [(a["uid"], a["vec_id"], None if null else vec_id, score) for score, null, vec_id in top]
                columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays(columns, ["uid", "query_id", "vec_id", "score"])

    return pairs.mapInArrow(search, "uid long, query_id long, vec_id long, score long")


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: float = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query, ties to the smaller id."""
    vectors = stored(whole_vectors(table, scale).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    sampled = vectors.orderBy(F.xxhash64("uid")).limit(SAMPLE).collect()
    pivots = spread_out([r["v"] for r in sampled])
    sample = Block([r["uid"] for r in sampled], [r["vec_id"] for r in sampled], [r["v"] for r in sampled], pivots)
    queries = vectors.where(is_query)
    buckets = queries.count() // QUERY_ROWS + 1
    blocks = stored(_packed(vectors, pivots), "blocks")
    asked = stored(_started(queries, sample, pivots, k, buckets), "queries")
    spread = blocks.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    pairs = spread.join(F.broadcast(asked) if buckets <= BROADCAST_BUCKETS else asked, "bucket").select("n", "columns", "queries")
    best = Window.partitionBy("uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = _met(pairs, pivots, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
