import random

import pytest
from pyspark.sql import functions as F

from chatterloom.llm import near_dups
from chatterloom.llm.components import components
from tests.llm import data


def plain(rows, width):
    """Components by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), top(d)) for d in ids}


def near_copies(n, seed, words=60):
    r = random.Random(seed)
    base = data.prose(seed, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = data.prose(r.random(), 1)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [32, 2])
def test_against_all_pairs(spark, monkeypatch, small):
    """Also with nodes so small that most of the work goes over pivots and deeper levels."""
    monkeypatch.setattr(near_dups, "SMALL", small)
    shared = data.prose(77, 25)
    texts = [t for s in range(6) for t in near_copies(12, s)] + [f"{shared} {data.prose(100 + i, 30)}" for i in range(40)] + ["Ab cd", "ab CD", "x", "", None]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dups.near_duplicates(docs, 4).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == plain(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_pairs_in_a_large_family(spark):
    """Copies at 0.80 to 0.85 among 2000 texts about 0.75 alike stay together in some node, ten branchings deep."""
    shared, n, copies = data.prose(5, 120), 1500, 500
    own = [data.prose(1000 + i, 20).split() for i in range(n)]
    twins = [own[i][:7] + data.prose(9000 + i, 13).split() for i in range(copies)]
    texts = [f"{shared} {' '.join(w)}" for w in own + twins]

    def alike(a, b):
        x, y = ({tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (texts[a].split(), texts[b].split()))
        return len(x & y) / len(x | y)

    assert all(0.80 <= alike(i, n + i) <= 0.85 and 0.7 < alike(i, i + 1) < 0.8 for i in range(copies))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = near_dups.signatures(docs, 4).select(
        "doc_id", F.posexplode("tokens").alias("tree", "token"), F.concat("sketch", "further").alias("least")
    ).select("doc_id", "least", F.xxhash64("tree", "token").alias("node"))
    for level in range(1, 11):
        rows = near_dups._branched(rows, level)
    nodes = {}
    for r in rows.select("doc_id", "node").collect():
        nodes.setdefault(r.doc_id, set()).add(r.node)
    found = sum(bool(nodes[i] & nodes[n + i]) for i in range(copies))
    others = sum(bool(nodes[i] & nodes[i + 1]) for i in range(copies))
    print("together", found, "of", copies, "others", others)
    assert found >= 0.97 * copies
    assert others < found
    assert max(near_dups.escape(depth) for depth in range(16)) < 0.01


def family(n, copies):
    """Texts about 0.75 alike, each of the first ``copies`` with a twin at 0.80 to 0.85."""
    shared = data.prose(5, 120)
    own = [data.prose(1000 + i, 20).split() for i in range(n)]
    twins = [own[i][:7] + data.prose(9000 + i, 13).split() for i in range(copies)]
    return [f"{shared} {' '.join(w)}" for w in own + twins]


@pytest.mark.parametrize("small", [4096, 150])
def test_twins_in_a_large_family_are_found(spark, monkeypatch, small):
    """By the operator itself, in one node and over branched ones; nothing else is linked."""
    monkeypatch.setattr(near_dups, "SMALL", small)
    monkeypatch.setattr(near_dups, "BLOCK", 200)
    n, copies = 900, 300
    docs = spark.createDataFrame(list(enumerate(family(n, copies))), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs, 4).collect()}
    wrong = [i for i, c in found.items() if c != i and (i < n or c != i - n)]
    together = sum(found[n + i] == i for i in range(copies))
    print("twins", together, "of", copies)
    assert not wrong and together >= 0.99 * copies


def test_only_suspects_become_rows(spark, monkeypatch):
    """Members per level, not pairs: twice the family makes about twice the rows."""
    made = {}
    suspected = near_dups._suspected

    def counted(members):
        out = near_dups.cut_lineage(suspected(members))
        made[n] = made.get(n, 0) + members.count() + out.count()
        return out

    monkeypatch.setattr(near_dups, "_suspected", counted)
    for n in (250, 500):
        docs = spark.createDataFrame(list(enumerate(family(n, 0))), "doc_id long, text string").repartition(4)
        assert all(r.kept for r in near_dups.near_duplicates(docs, 4).collect())
    assert made[500] <= 2.2 * made[250] and made[500] < 500 * 499 / 2


def test_exact_links_join_what_all_pairs_join():
    r = random.Random(3)
    import numpy as np

    for _ in range(40):
        bases = [[r.randrange(10_000) for _ in range(40)] for _ in range(3)]
        sets = [np.unique([x if r.random() > 0.12 else r.randrange(10_000) for x in r.choice(bases)]).astype(np.uint64) for _ in range(25)]
        comps = np.array([r.randrange(20) for _ in sets])
        asks = np.ones(len(sets), bool)
        alike = [(i, j) for i in range(25) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

        def joined(links, comps=comps):
            of = comps.tolist()
            for i, j in links:
                of = [of[i] if c == of[j] else c for c in of]
            return [of.index(c) for c in of]

        links = near_dups.exact_links(comps, asks, sets)
        assert joined(links) == joined(alike) and len(links) <= len(set(comps.tolist())) - 1


def test_an_id_with_two_texts(spark):
    """Both texts count; other rows are linked with either."""
    texts = [data.prose(i, 40) for i in (1, 2)]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[1]), (6, texts[0] + " more"), (7, texts[1] + " more")]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (6, 5), (7, 5)}


def test_edges(spark):
    got = near_dups.near_duplicates(data.edge_docs(spark)).collect()
    assert len(got) == len(data.edge_rows())
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 1), (7, 7), (8, 8), (None, None)}
    assert all(r.kept for r in got if r.doc_id != 6)
    stays = near_dups.without_near_duplicates(data.edge_docs(spark))
    assert stays.columns == data.edge_docs(spark).columns and stays.count() == len(got) - 1
    assert near_dups.near_duplicates(data.empty_docs(spark)).count() == 0


@pytest.mark.parametrize("local", [200_000, 5])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr("chatterloom.llm.components.packed.__defaults__", (local,))
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 100), (50, 50), (60, 70), (65, 70)] + [(200, 200 + i) for i in range(1, 40)]
    df = spark.createDataFrame(links, "u long, v long").repartition(4)
    got = {(r.node, r.component) for r in components(df).collect()}
    want = {(i, 0) for i in range(31)} | {(100, 100), (101, 100), (60, 60), (65, 60), (70, 60)} | {(200 + i, 200) for i in range(40)}
    assert got == want
