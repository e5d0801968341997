"""Boundaries learned from text without marks."""

import math
import random

from chatterloom.operators import sentences as S


def corpus():
    """Abbreviations before names and numbers, at the end of sentences, and ordinary words at both places."""
    r = random.Random(3)
    names, verbs, things = ["Smith", "Jones", "Brown", "Adler"], ["sees", "likes", "knows", "calls"], ["house", "river", "garden", "letter", "bridge"]
    out = []
    for i in range(240):
        a, b = r.choice(names), r.choice(names)
        out.append(
            f"Dr. {a} {r.choice(verbs)} the {r.choice(things)} of Mr. {b} and the {r.choice(things)}. She came at {i % 12 + 1} p.m. from the {r.choice(things)}. "
            f"We met at {i % 11 + 1} p.m. She {r.choice(verbs)} a {r.choice(things)}! It was what she wanted? {a} said that it was the {r.choice(things)}."
        )
    return out


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_learned_boundaries(spark):
    texts = corpus()
    learned = S.learn(table(spark, texts), "text")
    assert {r["word"] for r in learned.abbreviations().collect()} == {"dr", "mr", "p.m"}
    new = ["Dr. Smith likes it. We met at 3 p.m. She was late.", 'He called "Mr. Jones." It rained at 5 p.m. from noon. No end', "One", "", None, "One"]
    got = {}
    for r in S.sentences(table(spark, new), "doc_id", "text", learned).orderBy("doc_id", "sentence_no").collect():
        got.setdefault(r["doc_id"], []).append(r["sentence"])
    assert got == {
        0: ["Dr. Smith likes it.", "We met at 3 p.m.", "She was late."],
        1: ['He called "Mr. Jones."', "It rained at 5 p.m. from noon.", "No end"],
        2: ["One"],
        5: ["One"],
    }


def test_scores_equal_plain_counts(spark):
    texts = corpus()[:40]
    counts = {}
    for token in (t for text in texts for t in text.split()):
        word = token.removesuffix(".").lower()
        counts.setdefault(word, [0, 0])[0 if token.endswith(".") else 1] += 1
    n, w = sum(map(sum, counts.values())), sum(c[0] for c in counts.values())
    for r in S.period_scores(table(spark, texts), "text").collect():
        a, b = counts.pop(r["word"])
        assert (r["n_with"], r["n_without"]) == (a, b)
        letters = r["word"].replace(".", "")
        want = 0.0
        if a and any(c.isalpha() for c in letters):
            chance = a * math.log(w / n) + b * math.log(1 - w / n)
            one = a * math.log(0.99) + b * math.log(0.01)
            want = -2 * (chance - one) * math.exp(-len(letters)) * (r["word"].count(".") + 1) * len(letters) ** -float(b)
        assert math.isclose(r["score"], want, rel_tol=1e-9, abs_tol=1e-12)
    assert not counts


def test_nothing_is_lost(spark):
    """Sentences of a text are its tokens in order; repeated ids with other texts and null ids are cut by their own."""
    texts = corpus()[:10]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (2, "No period at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = S.learn(docs, "text")
    got = S.sentences(docs, "doc_id", "text", learned).collect()
    assert sorted(w for r in got for w in r["sentence"].split()) == sorted(w for _, t in rows for w in t.split())
    assert S.learn(docs.limit(0), "text").words.count() == 0


def test_ends_move_without_their_text(spark):
    """No row of a sentence end carries the tokens of the whole text into a shuffle."""
    docs = table(spark, corpus()[:10])
    key = docs.columns[0]
    cut = S.sentences(docs, key, "text", S.learn(docs, "text"))
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [" in line and "_i#" in line]
    assert grouped and not any("_t#" in line for line in grouped)
