import hashlib
import random

from pyspark.sql import functions as F

from chatterloom.llm import fingerprints as fp
from tests.llm import data


def plain(docs):
    """Edited texts with plain Python: ids descending, null last."""
    rows = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        out.append((doc_id, len(text), hashlib.sha256((text[: len(text) - k] + following[:k]).encode()).hexdigest()))
    return out


def test_edited_texts_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(fp, "SLICE_ROWS", 3)
    monkeypatch.setattr(fp, "_GROUP", 4)
    texts = [data.prose(i, i % 17) for i in range(120)]
    docs = spark.createDataFrame([(i * i * 1_000_003, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = fp.edited_fingerprints(docs).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(plain([(r.doc_id, r.text) for r in docs.collect()]))
    own = {r.doc_id: r.fingerprint for r in got}
    ids = sorted(own, reverse=True)
    assert all(r.next == own[ids[(ids.index(r.doc_id) + 1) % len(ids)]] for r in got)


def test_equal_texts_and_edges(spark):
    got = fp.edited_fingerprints(data.edge_docs(spark)).collect()
    assert len(got) == len(data.edge_rows())
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r.fingerprint)
    assert len({*by_id[1], *by_id[6]}) == 1
    assert by_id[2] == by_id[3] == by_id[4] == [0]
    assert fp.edited_fingerprints(data.empty_docs(spark)).count() == 0


def test_votes_against_plain_counting(spark):
    text = "a b c a b c d"
    terms = spark.range(1).select(F.explode(fp.terms(F.lit(text))).alias("t")).collect()
    want = sum(1 << b for b in range(64) if 2 * sum(t.t >> b & 1 for t in terms) > len(terms))
    got = fp.edited_fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().fingerprint
    assert got % (1 << 64) == want


def test_search_finds_all_within_the_radius(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = base + [b ^ sum(1 << p for p in r.sample(range(64), k)) for b in base for k in (1, 2, 3, 4, 5)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in [*signed, None, signed[0]]], "fingerprint long")
    got = {(x.query, x.found, x.distance) for x in fp.within_radius(df, df).collect()}
    want = {(a, b, bin((a ^ b) % (1 << 64)).count("1")) for a in signed for b in signed}
    assert got == {w for w in want if w[2] <= 3}
    assert fp.within_radius(df, df).count() == len(got)
