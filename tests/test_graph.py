import random

import pytest

from chatterloom.operators import graph as G

G1 = [(0, 3), (2, 1), (3, 2), (3, 5), (3, 9), (5, 4), (5, 6), (6, 8), (8, 7)]
G2 = [(0, 3), (0, 8), (1, 2), (3, 5), (3, 6), (5, 1), (5, 4), (6, 7)]
DIAMOND = [(0, 1, 1.0), (0, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)]


def edges_df(spark, edges):
    schema = "src bigint, dst bigint" + (", weight double" if edges and len(edges[0]) == 3 else "")
    return spark.createDataFrame(edges, schema)


def test_projectivity(spark):
    assert G.projectivity(spark.range(10), edges_df(spark, G1)).first()[0] is True
    assert G.projectivity(spark.range(9), edges_df(spark, G2)).first()[0] is False


def test_sample_graph(spark):
    edges, vertices = edges_df(spark, G1), spark.range(10)
    assert [r["id"] for r in G.without_incoming(vertices, edges).collect()] == [0]
    assert G.count_components(vertices, edges).first()[0] == 1
    assert G.is_reachable(edges, 0, 7).first()[0] and not G.is_reachable(edges, 7, 0).first()[0]
    assert G.bfs_path(edges, 0, 7).first()["path"] == [0, 3, 5, 6, 8, 7]
    assert G.bfs_path(edges, 7, 0).count() == 0
    assert {r["id"]: r["degree"] for r in G.out_degree(vertices, edges).collect()}[3] == 3


def test_diamond(spark):
    edges = edges_df(spark, DIAMOND)
    assert {r["id"]: r["dist"] for r in G.shortest_distances(edges, 0).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}
    assert G.shortest_path(edges, 0, 3).first()["path"] == [0, 1, 3]
    assert sorted(r["path"] for r in G.all_shortest_paths(edges, 0, 3).collect()) == [[0, 1, 3], [0, 2, 3]]
    assert G.count_shortest_paths(edges, 0, 3).first()[0] == 2


def test_pages_of_paths(spark):
    """Any page of a listing equals that slice of all paths in order; a ladder of 8 squares has 256 paths."""
    rungs = [(3 * i, 3 * i + k, 1.0) for i in range(8) for k in (1, 2)] + [(3 * i + k, 3 * i + 3, 1.0) for i in range(8) for k in (1, 2)]
    edges = edges_df(spark, rungs)
    assert G.count_shortest_paths(edges, 0, 24).first()["n_paths"] == 256
    every = [[0, *(x for i, c in enumerate(f"{nr:08b}") for x in (3 * i + 1 + int(c), 3 * i + 3))] for nr in range(256)]
    page = sorted(map(tuple, G.shortest_path_page(edges, 0, 24, first=250, size=10).collect()))
    assert [(nr, list(path)) for nr, path in page] == list(enumerate(every))[250:]
    assert G.shortest_path_page(edges, 0, 24, first=300).count() == 0 and G.shortest_path_page(edges, 24, 0).count() == 0
    assert [r["path"] for r in G.all_shortest_paths(edges, 6, 6).collect()] == [[6]]


def test_paths_of_any_length(spark):
    """Doubling walks chains whose length is no power of two, and from the root itself."""
    edges = edges_df(spark, [(i, i + 1, 1.0) for i in range(13)])
    for goal in (0, 1, 2, 7, 8, 13):
        assert G.bfs_path(edges, 0, goal).first()["path"] == list(range(goal + 1))
        assert G.shortest_path(edges, 0, goal).first()["path"] == list(range(goal + 1))


def test_edit(spark):
    edges = edges_df(spark, [(0, 1)])
    both = G.insert_edges(edges, edges_df(spark, [(1, 2), (0, 1)]), directed=False, unique=True)
    assert sorted(map(tuple, both.collect())) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert sorted(map(tuple, G.remove_edges(both, edges_df(spark, [(2, 1)]), directed=False).collect())) == [(0, 1), (1, 0)]
    assert sorted(map(tuple, G.edge_list(both, directed=False).collect())) == [(0, 1), (1, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graph_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 14
    weighted = {}
    for _ in range(22):
        weighted[rng.randrange(n), rng.randrange(n)] = float(rng.randint(1, 4))
    edges = edges_df(spark, [(u, v, w) for (u, v), w in weighted.items()])
    inf = float("inf")
    dist = [[0 if i == j else weighted.get((i, j), inf) for j in range(n)] for i in range(n)]
    for k in range(n):
        for i in range(n):
            for j in range(n):
                dist[i][j] = min(dist[i][j], dist[i][k] + dist[k][j])
    vertices = spark.range(n)
    pairs = {(r["src"], r["dst"]): r["dist"] for r in G.all_pairs_distances(vertices, edges).collect()}
    wanted = {(i, j): dist[i][j] for i in range(n) for j in range(n) if dist[i][j] < inf}
    assert pairs == wanted
    assert {tuple(r) for r in G.transitive_closure(vertices, edges).collect()} == set(wanted)
    labels = {r["id"]: r["component"] for r in G.components(vertices, edges).collect()}
    assert labels == {j: min(i for i in range(n) if dist[i][j] < inf) for j in range(n)}
    tree = {r["id"]: r for r in G.bfs_forest(vertices, edges).collect()}
    assert {v: t["component"] for v, t in tree.items()} == labels
    for v, t in tree.items():
        assert t["level"] == (0 if t["parent"] is None else tree[t["parent"]]["level"] + 1)
    single = {r["id"]: r["dist"] for r in G.shortest_distances(edges, 0).collect()}
    assert single == {j: dist[0][j] for j in range(n) if dist[0][j] < inf}


def test_tiny_two_way_weights_end(spark):
    """Weights far below the tolerance in both directions must not make a cycle of shortest-path edges."""
    edges = edges_df(spark, [(0, 1, 1e-12), (1, 0, 1e-12), (1, 2, 1.0), (2, 1, 1.0)])
    assert {tuple(r["path"]) for r in G.all_shortest_paths(edges, 0, 2).collect()} == {(0, 1, 2)}
    assert G.count_shortest_paths(edges, 0, 2).first()["n_paths"] == 1


def test_all_pairs_join_only_what_is_new(spark, monkeypatch):
    """A chain: every round offers pairs that are not known yet, not all known ones again."""
    n, offered = 24, []
    longer = G._longer

    def counted(left, right):
        out = longer(left, right)
        offered.append(out.count())
        return out

    monkeypatch.setattr(G, "_longer", counted)
    edges = edges_df(spark, [(i, i + 1, 1.0) for i in range(n)])
    pairs = {tuple(r) for r in G.all_pairs_distances(spark.range(n + 1), edges).collect()}
    assert pairs == {(i, j, float(j - i)) for i in range(n + 1) for j in range(i, n + 1)}
    # All ways to cut a pair into two shorter ones, once each, are n * (n + 1) * (n - 1) / 6.
    assert sum(offered) <= n * (n + 1) * (n - 1) // 6


def test_all_pairs_with_nulls_and_strangers(spark):
    rows = [(0, 1, 2.0), (0, 1, 1.0), (1, None, 1.0), (None, 1, 1.0), (7, 8, 1.0), (7, 1, 1.0), (1, 8, 3.0), (9, 8, 1.0)]
    edges = edges_df(spark, rows)
    vertices = spark.createDataFrame([(0,), (0,), (1,), (None,)], "id long")
    pairs = sorted(map(str, map(tuple, G.all_pairs_distances(vertices, edges).collect())))
    wanted = [(0, 0, 0.0), (1, 1, 0.0), (None, None, 0.0), (0, 1, 1.0), (1, None, 1.0), (0, None, 2.0), (7, 1, 1.0), (7, 8, 1.0), (1, 8, 3.0), (0, 8, 4.0)]
    assert pairs == sorted(map(str, wanted))
