"""Clusters and best inner products against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterloom.llm import pivot_search, simplex
from chatterloom.llm.pivot_search import top_k
from chatterloom.llm.simplex import centroid_hash, clustered

TYPE = "vec_id long, embedding array<double>, label int"


def some(n, dims, seed, groups=5):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [m + r.gauss(0, 0.3) for m in r.choice(middles)], 0) for i in range(n)]


def odd_rows(dims):
    """Vectors that take no part, with nulls in each column, and ones that do although they look odd."""
    x = [0.25] * dims
    return [
        (1000, None, 0), (1001, [], 0), (1002, [None, *x[1:]], 0), (1003, [math.nan, *x[1:]], 0), (1004, [math.inf, *x[1:]], 0), (1005, [-math.inf, *x[1:]], 0),
        (1006, x[1:], 0), (1007, [*x, 0.5], 0), (1008, x, None), (None, x, 0), (1009, x, 0), (1009, x, 0), (1050, [0.0] * dims, 0), (1050, [0.0] * dims, 0),
    ]


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * c) for c in x]) for i, x, _ in rows if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    total = sum(d for d, _ in found)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(str((i, c, d, sum(e for e, o in found if o == c), total, sha[c])) for (i, _), (d, c) in zip(kept, found))


def rows_of(df, *columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("rows", [some(300, 64, 1) + odd_rows(64), some(5, 64, 2), [(i, [0.5] * 64, 0) for i in range(20)], []], ids=["mixed", "few", "equal", "none"])
def test_clusters(spark, rows):
    table = spark.createDataFrame(rows, TYPE).repartition(3).withColumns({"v": F.lit(1), "cluster": F.lit("x"), "y": F.lit(None)})
    found = clustered(table)
    got = rows_of(found, "vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid_hash(found["centroid"]))
    assert got == plain_clusters(rows, 8, 10, 64)


def test_bounds_hold_and_save_comparisons():
    v = np.array([[math.floor(1024 * c) for c in x] for _, x, _ in some(2000, 64, 3, 8)])
    at = simplex.Projection(simplex.base_simplex(v[:200].tolist()))
    y, h = at.apex(at.distances(v))
    centroids = v[[5, 50, 500, 1000, 1500, 1600, 1700, 1800]]
    z, g = at.apex(at.distances(centroids))
    d = ((v[:, None, :] - centroids) ** 2).sum(axis=2)
    flat = ((y[:, None, :] - z) ** 2).sum(axis=2)
    slack = simplex.SLACK * d.max()
    assert (flat + (h[:, None] - g) ** 2 <= d + slack).all() and (flat + (h[:, None] + g) ** 2 >= d - slack).all()
    cluster, best, compared = simplex.nearest(v, y, h, centroids, at)
    assert (cluster == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert compared < 0.5 * d.size


def test_ties_go_to_the_smaller_number():
    v = np.array([[0, 0], [2, 0], [1, 0], [1, 5]])
    at = simplex.Projection(simplex.base_simplex(v.tolist()))
    cluster, best, _ = simplex.nearest(v, *at.apex(at.distances(v)), np.array([[2, 0], [0, 0], [0, 0]]), at)
    assert cluster.tolist() == [1, 0, 0, 0] and best.tolist() == [0, 0, 1, 26]


def plain_top(rows, k, every):
    kept = [(i, [math.floor(256 * c) for c in x]) for i, x, _ in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for at, (i, q) in enumerate(kept):
        if i is not None and i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for other, (j, v) in enumerate(kept) if other != at)[:k]
            out += [str((i, rank, None if null else j, -s)) for rank, (s, null, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("rows", [some(400, 16, 4) + odd_rows(16), some(4, 8, 5), [(i, [0.5] * 8, 0) for i in range(120)], [(0, [], 0), (50, [], 0)], []], ids=["mixed", "few", "equal", "no components", "none"])
@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, rows, small):
    """Also with small blocks, many query buckets and no broadcast."""
    if small:
        for name, value in {"SAMPLE": 7, "BLOCK_ROWS": 30, "QUERY_ROWS": 2, "PORTIONS": (4, 8), "BROADCAST_BUCKETS": 1, "PIVOTS": 5}.items():
            monkeypatch.setattr(pivot_search, name, value)
    table = spark.createDataFrame(rows, TYPE).repartition(3).withColumns({"uid": F.lit("x"), "score": F.lit(1), "bucket": F.lit(None), "n": F.lit(0)})
    got = rows_of(top_k(table, F.col("vec_id") % 10 == 0), "query_id", "rank", "vec_id", "score")
    assert got == plain_top(rows, 5, 10)


def test_search_stops_early():
    vectors = [[math.floor(256 * c) for c in x] for _, x, _ in some(3000, 16, 6, 20)]
    pivots = pivot_search.spread_out(vectors[:500])
    block = pivot_search.Block(list(range(3000)), list(range(3000)), vectors, pivots)
    asked = pivot_search.Block(list(range(0, 3000, 100)), [None] * 30, vectors[::100], pivots)
    seen = 0
    for i, (top, n) in zip(range(0, 3000, 100), pivot_search.best_of_all(block, asked, 5)):
        seen += n
        scores = (block.v @ block.v[i]).tolist()
        assert sorted((-s, j) for j, s in enumerate(scores) if j != i)[:5] == [(-s, j) for s, _, j in top]
    assert seen < 0.5 * 30 * 3000


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 22])
def test_scores_are_exact_in_every_type(scale):
    r = random.Random(scale)
    vectors = [[r.randint(-16 * scale, 16 * scale) for _ in range(8)] for _ in range(200)]
    pivots = pivot_search.spread_out(vectors)
    block = pivot_search.Block(list(range(200)), list(range(200)), vectors, pivots)
    for i, (top, _) in enumerate(pivot_search.best_of_all(block, block, 5)):
        plain = sorted((-sum(a * b for a, b in zip(vectors[i], v)), j) for j, v in enumerate(vectors) if j != i)[:5]
        assert plain == [(-s, j) for s, _, j in top]


def test_large_components_are_refused(spark):
    table = spark.createDataFrame([(0, [1e9, 1.0], 0)], TYPE)
    with pytest.raises(Exception, match="a component of"):
        top_k(table, F.col("vec_id") % 10 == 0).collect()
