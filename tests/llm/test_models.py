"""Mixing, toxicity, quality, language, personal data and archives."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterloom.llm import langid, mixing, pii, quality, toxicity, warc
from tests.llm import data


def water(sizes, weights=(3, 1, 2)):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] >= 2 * sizes[s]}
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing_meets_its_targets(spark):
    r = random.Random(1)
    rows = [(i, data.prose(i, r.randint(0, 40)), "en", r.choice(["a", "b", "b", "b", "c", None, "z"]), 1) for i in range(600)]
    docs = spark.createDataFrame(rows, data.DOCS)
    got = mixing.mix(docs).collect()
    sizes, taken = {}, {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
        assert x.taken in (0, x.size, 2 * x.size)
    want = water(sizes)
    for x in got:
        assert x.source_size == sizes[x.source] and math.isclose(x.target, want[x.source])
    assert all(abs(taken[s] - want[s]) <= 3 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_mixing_fills_past_long_texts(spark):
    """One text is a third of its source; rows are repeated too. Only what no longer fits stays out."""
    short = [(i, data.prose(i, 20 + i % 3), "en", "b", 1) for i in range(300)]
    docs = spark.createDataFrame([*short, *short[:40], (1000, data.prose(1000, 3500), "en", "b", 1), (1001, data.prose(1, 2000), "en", "a", 1)], data.DOCS)
    # With these ids the long text's rank is among the lowest ones.
    for long_id in (8034, 8006):
        tried = docs.withColumn("doc_id", F.when(F.col("doc_id") == 1000, long_id).otherwise(F.col("doc_id")))
        got = mixing.mix(tried, weights=(1, 1), share=0.5).where("source = 'b'").collect()
        units, gap = {}, got[0].target
        for x in got:
            gap -= x.taken
            units.setdefault(x.doc_id, []).append(x)
        assert all(len({x.copies for x in u}) == 1 for u in units.values())
        assert -66 < gap < 100  # a repeated row may be among the three fills
        assert all(sum(x.size for x in u) > gap for u in units.values() if not u[0].copies)


def test_mixing_edges(spark):
    docs = data.edge_docs(spark)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns
    assert mixed.count() == sum(x.copies > 0 for x in mixing.mix(docs).collect())
    assert mixing.mix(data.empty_docs(spark)).count() == 0
    assert all(x.taken <= 2 * x.size for x in mixing.mix(docs).collect())


def test_pareto_ranks_favour_larger_odds(spark):
    df = spark.range(4000).select(mixing.pareto_rank(mixing.uniform(F.col("id")), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0)).alias("r"), (F.col("id") % 2).alias("k"))
    first = df.orderBy("r").limit(1000).groupBy("k").count().collect()
    counts = {x.k: x["count"] for x in first}
    assert counts[0] > 2 * counts[1]


def test_toxicity_learns_a_pair(spark):
    """Insult and group together are toxic, each alone is not: no sum of single weights can say that."""
    r = random.Random(5)
    texts, labels = [], []
    for i in range(1600):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(" ".join([data.prose(i, 12)] + ["dolt"] * a + ["newcomers"] * b))
        labels.append((i, None, int(a and b)))
    docs = data.documents(spark, texts)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x.score for x in toxicity.scores(docs, model).collect()}
    right = np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in labels])
    assert right > 0.97
    clean = toxicity.without_toxic(docs, model)
    assert clean.columns == docs.columns and 1100 < clean.count() < 1300


def test_toxicity_learns_exactly_one_of_two():
    """Neither term alone differs from chance; only their pair tells."""
    r = random.Random(1)
    texts, labels = [], []
    for i in range(4000):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(" ".join([data.prose(i, 20), *["dolt"] * a, *["newcomers"] * b]))
        labels.append(float(a != b))
    rows, labels = [toxicity.terms(t) for t in texts], np.array(labels)
    model = toxicity.train(rows[:3000], labels[:3000])
    right = (model.scores(rows[3000:]) >= 0.5) == (labels[3000:] > 0)
    assert right.mean() > 0.97


def test_toxicity_sums_all_pairs():
    """The factorised score against the plain sum over pairs of terms."""
    rng = np.random.default_rng(5)
    model = toxicity.Model(0.3, np.arange(30), rng.normal(size=30), rng.normal(size=(30, 4)))
    rows = [np.array(sorted(rng.choice(np.arange(1, 30), n, replace=False)), np.int64) for n in (0, 1, 2, 9, 20)]
    z = toxicity._forward(model, rows)[0]
    for got, row in zip(z, rows):
        pairs = sum(model.factors[a] @ model.factors[b] for i, a in enumerate(row) for b in row[:i])
        assert math.isclose(got, 0.3 + model.weights[row].sum() + pairs, abs_tol=1e-9)


def test_toxicity_samples_the_smallest_hashes(spark):
    docs = data.documents(spark, [f"text {i}" for i in range(200)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    some = {r.text for r in toxicity.sample(docs, labels, 50).collect()}
    more = {r.text for r in toxicity.sample(docs, labels, 100).collect()}
    assert len(some) == 50 and len(more) == 100 and some < more


def test_toxicity_edges(spark):
    docs = data.edge_docs(spark)
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    scores = toxicity.scores(docs, toxicity.fit(docs, labels)).collect()
    assert len(scores) == docs.count() and all(0 <= x.score <= 1 for x in scores)
    none = toxicity.fit(docs, labels.limit(0))
    assert all(x.score < 1e-5 for x in toxicity.scores(docs, none).collect())
    assert toxicity.without_toxic(data.empty_docs(spark), none).count() == 0
    assert toxicity.without_toxic(docs, none).schema == docs.schema


def direct(texts, lang, text):
    """Perplexity by a plain dictionary form of the same model."""
    n_max, pad = quality.ORDER, ["<"] * (quality.ORDER - 1)
    grams = {}
    for t in texts:
        s = pad + list(t)
        for i in range(n_max - 1, len(s)):
            g = tuple(s[i - n_max + 1 : i + 1])
            grams[g] = grams.get(g, 0) + 1
    level = {n_max: grams}
    for n in range(n_max - 1, 0, -1):
        level[n] = {}
        for g in level[n + 1]:
            level[n][g[1:]] = level[n].get(g[1:], 0) + 1
    off, totals, kinds = {}, {}, {}
    for n, counts in level.items():
        c = [sum(v == k for v in counts.values()) for k in range(5)]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0
        off[n] = [0] + [max(0.1, min(k - 0.1, k - (k + 1) * y * c[k + 1] / c[k])) if k < 4 and c[k] and c[1] else 0.5 for k in (1, 2, 3)] if len(c) > 4 else None
        totals[n], kinds[n] = {}, {}
        for g, v in counts.items():
            totals[n][g[:-1]] = totals[n].get(g[:-1], 0) + v
            kinds[n].setdefault(g[:-1], []).append(min(v, 3))

    def p(g):
        n = len(g)
        below = p(g[1:]) if n > 1 else 1 / (len(level[1]) + 1)
        h = g[:-1]
        if h not in totals[n]:
            return below
        gamma = sum(off[n][k] for k in kinds[n][h]) / totals[n][h]
        v = level[n].get(g, 0)
        return ((v - off[n][min(v, 3)]) / totals[n][h] if v else 0) + gamma * below

    s = pad + list(text)
    return math.exp(-sum(math.log(p(tuple(s[i - n_max + 1 : i + 1]))) for i in range(n_max - 1, len(s))) / len(text))


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_perplexity_against_a_plain_model(spark, most):
    trusted = [data.prose(i, 30, "abcde") for i in range(12)]
    asked = [data.prose(50, 20, "abcde"), data.prose(51, 9, "abcxyz"), "ABC ?!", trusted[0], "a", "\U0001f600\U0001f600"]
    model = quality.model(data.documents(spark, trusted))
    got = {x.doc_id: x.perplexity for x in quality.perplexities(data.documents(spark, [*asked, "", None]), model, most).collect()}
    for i, text in enumerate(asked):
        assert math.isclose(got[i], direct(trusted, "en", text), rel_tol=1e-4), text
    assert got[6] is None and got[7] is None


def test_quality_edges(spark):
    docs = data.edge_docs(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 5, 6, 7)] + [(None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(not x.kept for x in got if x.doc_id in (2, 3))
    assert quality.judged(docs, labels.limit(0)).where("kept").count() == 8
    assert quality.judged(data.empty_docs(spark), labels).count() == 0


def longest_phrases(sample, text):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


def test_phrases_against_substring_search(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 10_000)
    samples = {"x": data.prose(1, 80, "abcd"), "y": data.prose(2, 80, "bcde")}
    model = langid.train(samples)
    texts = [data.prose(7, 40, "abcde"), "zzz", "", "q", data.prose(1, 80, "abcd")[50:90], data.prose(3, 900, "abcd")]
    got = model.phrases(texts)
    size = min(map(len, samples.values())) * 4
    for i, t in enumerate(texts):
        for k, name in enumerate(model.languages):
            assert got[i, k] == longest_phrases(samples[name][:size], t)


def test_languages(spark):
    letters = {"aa": "abcdef", "bb": "defghi", "cc": "äöüabc"}
    rows = [(i, data.prose(i, 30, letters[k]), k, None, 0) for i in range(90) for k in [sorted(letters)[i % 3]]]
    docs = spark.createDataFrame(rows, data.DOCS)
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert all(x.lang_pred == rows[x.doc_id][2] and 0 <= x.score <= 1 for x in got)
    edges = langid.identify(data.edge_docs(spark), langid.fit(data.edge_docs(spark))).collect()
    assert len(edges) == data.edge_docs(spark).count()
    assert all(x.lang_pred == "und" and x.score == 0 for x in edges if x.doc_id in (2, 3, 4))
    nothing = langid.fit(data.empty_docs(spark))
    assert {x.lang_pred for x in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(data.empty_docs(spark), nothing).count() == 0


def test_one_short_sample_leaves_the_others_whole():
    texts = {k: data.prose(i, 4000, letters) for i, (k, letters) in enumerate({"aa": "abcdefgh", "bb": "abcdefgi"}.items())}
    model = langid.train({**texts, "zz": "abcdefgh abc defgh i"})
    alone = langid.train(texts)
    assert [len(t) for t in model.tables[:2]] == [len(t) for t in alone.tables]
    asked = [data.prose(50 + i, 30, "abcdefgh" if i % 2 else "abcdefgi") for i in range(40)]
    assert model.predict(asked)[0] == alone.predict(asked)[0] == ["aa" if i % 2 else "bb" for i in range(40)]


def test_scripts_of_thousands_of_letters():
    """Two languages share their 120 most frequent letters and differ in the order of thousands of others."""
    common, rare = [chr(0x4E00 + i) for i in range(120)], [chr(0x5E00 + i) for i in range(3000)]

    def text(seed, step):
        r, out = random.Random(seed), []
        for _ in range(60):
            at = r.randrange(3000)
            out += [r.choice(common), rare[at], rare[(at * 7 + step) % 3000], r.choice(common)]
        return "".join(out)

    model = langid.train({k: "".join(text(1000 * step + i, step) for i in range(120)) for k, step in {"xx": 1, "yy": 5}.items()})
    assert model.letters.size == 120 + langid.DIGITS + 1
    assert model.predict([text(99_000 + i, 1 if i % 2 else 5) for i in range(40)])[0] == ["xx" if i % 2 else "yy" for i in range(40)]


def test_languages_of_long_texts_only(spark):
    letters = {"aa": "abcdef", "bb": "ghijkl"}
    rows = [(i, data.prose(i, 30 if i % 2 else 2500, letters[k]), k, None, 0) for i in range(30) for k in ["bb" if i % 2 else "aa"]]
    assert min(len(r[1]) for r in rows if r[2] == "aa") > langid.SAMPLE_LONGEST
    model = langid.fit(spark.createDataFrame(rows, data.DOCS))
    assert model.languages == ["aa", "bb"] and model.predict([data.prose(99, 30, letters["aa"])])[0] == ["aa"]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 8 <= len(d) <= 15}
            if good[kind]():
                out.append((i, m.start(), m.end()))
    return out


def test_base_spans_against_the_patterns():
    r = random.Random(2)
    parts = ["a", "b.c", "@", "@@", ".", "-", " ", "+", "+49", "(", ")", "1.2.3.4", "300.1.1.1", "4111111111111111", "4111 1111 1111 1111", "12", "7", "é", "٣", "x@y.z", "\n"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_random_field(spark):
    r = random.Random(8)

    def card():
        d = [4] + [r.randrange(10) for _ in range(14)]
        return next(s for c in "0123456789" if pii.luhn(s := "".join(map(str, d)) + c))

    texts = []
    for i in range(150):
        entity = [f"{data.prose(i, 1)}.{i}@mail{i % 9}.example.com", f"{r.randrange(256)}.{r.randrange(256)}.{i}.7", card(), f"+1 ({200 + i}) 555-{1000 + i}"][i % 4]
        texts.append(f"{data.prose(i, 5)} {entity} {data.prose(i + 1, 4)}")
    docs = data.documents(spark, texts)
    model = pii.fit(docs)
    for t in texts:  # the model alone finds what the patterns find
        assert [x for a, b in pii.regions(t) for x in model.decode(t, a, b)] == pii.base_spans(t)
    two = f"ab {card()} 123456 cd"
    assert (2, 3, 19, False) in pii.spans(two, model) and not pii.base_spans(two)
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.spans if s.base] for x in pii.find(docs, model).collect()}
    assert got == {i: [(pii.KINDS[k], a, b) for k, a, b in plain_spans(t)] for i, t in enumerate(texts)}


def test_personal_data_edges(spark):
    docs = data.edge_docs(spark)
    assert pii.find(docs, pii.fit(docs)).count() == docs.count()
    assert pii.find(data.empty_docs(spark), pii.fit(data.empty_docs(spark))).count() == 0
    assert pii.spans("9" * 50_000 + "@" * 2000, pii.Model({})) == []


def test_loser_tree():
    r = random.Random(1)
    for n in range(0, 12):
        runs = [sorted((r.randrange(50), i) for _ in range(r.randrange(9))) for i in range(n)]
        assert list(warc.LoserTree([[(k, (k, i)) for k, i in run] for run in runs])) == sorted(x for run in runs for x in run)


PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    long = "<p>\r\n\r\nWARC/1.0\r\n\r\n é " + "x" * 120
    rows = [(i, f"http://www.Host{i % 3}.example.com:80/p?{i % 5}#f", f"{long}{i % 9}" if i % 2 else "short") for i in range(80)]
    rows += [(200, None, None), (201, "", ""), (202, "ftp://u@x.y/ a", long + "0"), (199, "http://host1.example.com", long + "0"), (199, "http://host1.example.com", long + "0")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS file", "1 AS offset").repartition(5)
    got = warc.histories(warc.archived(pages)).collect()
    first = {}
    for i, _, html in rows:
        first[html or ""] = min(i, first.get(html or "", i))
    want = sorted(
        (i, len((h or "").encode()), "revisit" if len((h or "").encode()) >= 100 and first[h] != i else "response", first[h] if len((h or "").encode()) >= 100 and first[h] != i else None)
        for i, _, h in rows
    )
    assert sorted((x.page_id, x.payload_bytes, x.record_type, x.refers_to) for x in got) == want
    ordered = sorted(got, key=lambda x: (x.slice, x.position))
    keys = [(x.url_key.encode(), x.captured, x.page_id) for x in ordered]
    assert keys == sorted(keys)
    numbers = {}
    for x in ordered:
        numbers[x.url_key] = numbers.get(x.url_key, 0) + 1
        assert x.capture_no == numbers[x.url_key]


def test_archives_edges(spark):
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0
    with pytest.raises(Exception, match="a capture needs an id"):
        warc.archived(spark.createDataFrame([(None, "u", "h")], PAGES)).count()
