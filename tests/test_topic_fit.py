"""All topic models in one pass against a plain loop for each model."""

import math
import random
from functools import partial

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from chatterloom.operators import topic_fit as T
from chatterloom.operators import topics as P

TERMS = 40


def corpus(seed=3, docs=60):
    r = random.Random(seed)
    themes = [r.sample(range(TERMS), 12) for _ in range(4)]
    out = []
    for i in range(docs):
        counts = {}
        for _ in range(r.randint(0, 25)):
            t = r.choice(themes[i % 4] if r.random() < 0.8 else range(TERMS))
            counts[t] = counts.get(t, 0) + 1
        out.append(counts)
    return out


def table(spark, docs):
    rows = [(i, SparseVector(TERMS, sorted(d.items()))) for i, d in enumerate(docs)]
    vocabulary = spark.createDataFrame([(i, f"term{i}", 1) for i in range(TERMS)], "idx long, term string, n long")
    return spark.createDataFrame(rows, ["doc_id", "features"]).repartition(3), vocabulary


def plain(docs, seeds, k, before, iterations, m):
    """Dictionaries and loops: counts per (document, topic) and (term, topic) from the same start."""
    alpha, eta = 50.0 / k + 1, 1.1
    shares = {}
    for j, d in enumerate(docs):
        if d:
            bags = T.Bags({"uid": np.array([j]).tobytes(), "seed": np.array([seeds[j]]).tobytes(), "size": np.array([len(d)]).tobytes(), "idx": np.array(sorted(d)).tobytes(), "n": np.array([float(d[t]) for t in sorted(d)]).tobytes()})
            for t, row in zip(sorted(d), bags.start(m)):
                shares[j, t] = row[before : before + k].tolist()

    def sums():
        doc, term = [[0.0] * k for _ in docs], [[0.0] * k for _ in range(TERMS)]
        for (j, t), g in shares.items():
            for c in range(k):
                doc[j][c] += docs[j][t] * g[c]
                term[t][c] += docs[j][t] * g[c]
        return doc, term, [sum(row[c] for row in term) for c in range(k)]

    for _ in range(iterations):
        doc, term, total = sums()
        for j, t in shares:
            g = [(term[t][c] + eta - 1) * (doc[j][c] + alpha - 1) / (total[c] + TERMS * (eta - 1)) for c in range(k)]
            shares[j, t] = [x / sum(g) for x in g]
    doc, term, total = sums()
    ll = 0.0
    for j, t in shares:
        theta = [x + alpha - 1 for x in doc[j]]
        ll += docs[j][t] * math.log(sum((term[t][c] + eta - 1) / (total[c] + TERMS * (eta - 1)) * theta[c] / sum(theta) for c in range(k)))
    return ll, doc, [[row[c] / total[c] for c in range(k)] for row in term]


@pytest.mark.parametrize("sent", [8_000_000, 0])
def test_all_models_equal_plain_loops(spark, monkeypatch, sent):
    """Sent to all tasks and joined to the blocks; in many small blocks and shards."""
    monkeypatch.setattr(T, "SENT_CELLS", sent)
    monkeypatch.setattr(P, "Models", partial(T.Models, shard=16))
    monkeypatch.setattr(T, "BLOCK_ENTRIES", 60)
    docs = corpus()
    bags, vocabulary = table(spark, docs)
    fitted = P.fit_topics(bags, vocabulary, ks=[2, 3, 5], iterations=6)
    seeds = {r["doc_id"]: r["seed"] for r in fitted.bags.select("doc_id", "seed").collect()}
    want = {k: plain(docs, seeds, k, at, 6, fitted.terms.m) for k, at in ((2, 0), (3, 2), (5, 5))}
    assert {k: pytest.approx(w[0], rel=1e-6) for k, w in want.items()} == fitted.log_likelihoods
    assert fitted.k == max(want, key=lambda k: want[k][0])
    _, doc, term = want[fitted.k]
    for r in P.training_weights(fitted, "doc_id").collect():
        whole = sum(doc[r["doc_id"]])
        assert r["weight"] == pytest.approx(doc[r["doc_id"]][r["topic_id"] - 1] / whole if whole else 1 / fitted.k, rel=1e-6)
    described = P.describe_topics(fitted, 4).collect()
    for c in range(fitted.k):
        top = sorted(((-round(row[c], 12), t) for t, row in enumerate(term)))[:4]
        assert [(r["term"], pytest.approx(r["weight"])) for r in sorted(described, key=lambda r: r["rank"]) if r["topic_id"] == c + 1] == [(f"term{t}", -w) for w, t in top]


@pytest.mark.parametrize("sent", [8_000_000, 0])
def test_fold_in_follows_the_formula(spark, monkeypatch, sent):
    monkeypatch.setattr(T, "SENT_CELLS", sent)
    monkeypatch.setattr(P, "Models", partial(T.Models, shard=16))
    bags, vocabulary = table(spark, corpus())
    fitted = P.fit_topics(bags, vocabulary, ks=[3], iterations=4)
    shares = {r["idx"]: r["weights"] for r in T.term_rows(fitted.terms, 3).collect()}
    totals, alpha = fitted.terms.totals, 50.0 / 3 + 1
    new = [d for d in corpus(seed=9, docs=8)]
    fresh, _ = table(spark, new)
    got = {(r["doc_id"], r["topic_id"]): r["weight"] for r in P.topic_weights(fitted, fresh, "doc_id").collect()}
    for j, d in enumerate(new):
        doc = [0.0] * 3
        for _ in range(4):
            add = [0.0] * 3
            for t, n in d.items():
                g = [(shares[t][c] * totals[c] + 0.1) / (totals[c] + TERMS * 0.1) * (doc[c] + alpha - 1) for c in range(3)]
                for c in range(3):
                    add[c] += n * g[c] / sum(g)
            doc = add
        for c in range(3):
            assert got[j, c + 1] == pytest.approx(doc[c] / sum(doc) if d else 1 / 3)


def test_no_documents(spark):
    bags, vocabulary = table(spark, [{0: 1}])
    fitted = P.fit_topics(bags.limit(0), vocabulary, ks=[2, 3], iterations=2)
    assert fitted.k == 2 and P.training_weights(fitted, "doc_id").count() == 0
    assert P.training_weights(fitted, "doc_id").select(F.sum("weight")).first()[0] is None
