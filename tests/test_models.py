import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatterloom.operators import ngram as N
from chatterloom.operators import sentiment as S
from chatterloom.operators import topics as P
from chatterloom.operators.relational import nest_comments, number_posts, parse_date, post_comments, unnest_texts
from chatterloom.operators.scale import global_rank, lagged, running_sum, split_left_join


def test_bigrams_hand_worked(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b"],)], "t array<string>")
    pairs = N.bigram_counts(df, "t")
    assert {(r["first"], r["second"]): r["freq"] for r in pairs.collect()} == {("", "a"): 1, ("a", "b"): 2, ("b", "a"): 1}
    unigrams = N.unigram_counts(df.select(F.explode("t").alias("token")))
    probs = {(r["first"], r["second"]): r["prob"] for r in N.conditional_probability(pairs, unigrams).collect()}
    assert probs == {("a", "b"): 1.0, ("b", "a"): 0.5}


def test_interpolation_weights(spark):
    rng = random.Random(1)
    docs = [([rng.choice("aabbbcde") for _ in range(30)],) for _ in range(20)]
    df = spark.createDataFrame(docs, "t array<string>")
    uni = Counter(t for (d,) in docs for t in d)
    bi = Counter(p for (d,) in docs for p in zip(["", *d], d))
    total, l1, rounds = sum(uni.values()), 0.5, 0
    while rounds < 11:
        c1 = c2 = 0.0
        for (a, b), n in bi.items():
            pc, pu = (n / uni[a] if a in uni else 0.0), uni[b] / total
            c1 += n * l1 * pc / (l1 * pc + (1 - l1) * pu)
            c2 += n * (1 - l1) * pu / (l1 * pc + (1 - l1) * pu)
        moved, l1, rounds = c1 / (c1 + c2) - l1, c1 / (c1 + c2), rounds + 1
        if math.sqrt(2) * abs(moved) <= 0.01:
            break
    got = N.interpolation_weights(N.bigram_counts(df, "t"), N.unigram_counts(df.select(F.explode("t").alias("token"))))
    assert got[0] == pytest.approx(l1) and got[0] + got[1] == pytest.approx(1) and got[2] == rounds


def test_ambiguity_needs_a_strictly_better_second_group(spark):
    triples = spark.createDataFrame([("a", "b", "c"), ("x", "y", "z"), ("a", "b", "q")], "first string, second string, third string")
    probs = spark.createDataFrame([("a", "b", 0.2), ("b", "c", 0.4)], "first string, second string, prob double")
    unigrams = spark.createDataFrame([("b", 1), ("c", 1)], "token string, freq bigint")
    out = {r["third"]: r["is_first_group"] for r in N.resolve_ambiguities(triples, probs, unigrams).collect()}
    assert out == {"c": False, "z": True, "q": True}


@pytest.mark.parametrize("block", [1, 3, 100])
def test_blocks_do_not_change_windows(spark, block):
    rows = [(g, i, (g * 7 + i * 3) % 5) for g in range(3) for i in range(10 + g)]
    df = spark.createDataFrame(rows, "g bigint, pos bigint, v bigint")
    before = {(r["g"], r["pos"]): r["p"] for r in lagged(df, ["g"], "pos", "v", -1, "p", block).collect()}
    sums = {(r["g"], r["pos"]): r["s"] for r in running_sum(df, ["g"], "pos", F.col("v"), "s", block).collect()}
    values = {(g, i): v for g, i, v in rows}
    assert len(before) == len(sums) == len(rows)
    for g, i, _ in rows:
        assert before[g, i] == values.get((g, i - 1), -1)
        assert sums[g, i] == sum(values[g, j] for j in range(i))


def test_global_rank_with_one_hot_group(spark):
    rows = [(0 if i % 3 else i % 5, (i * 37) % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g bigint, w bigint, id bigint")
    got = {r["id"]: r["rank"] for r in global_rank(df, [F.desc("w"), F.col("id")], ["g"]).collect()}
    for group in {g for g, _, _ in rows}:
        ordered = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in ordered] == list(range(1, len(ordered) + 1))


def test_nesting(spark):
    posts = spark.createDataFrame([(1, 10, "p"), (1, 11, "q"), (2, 10, "r")], "page_id bigint, post_id bigint, post_content string")
    rows = [(1, 10, i, f"c{i}") for i in range(25)] + [(2, 10, 1, "d"), (2, 10, 2, None), (3, 1, 1, "orphan")]
    comments = spark.createDataFrame(rows, "page_id bigint, post_id bigint, comment_id bigint, comment_content string")
    nested = nest_comments(number_posts(posts), comments, size=10).collect()
    hot = sorted((r for r in nested if (r["page_id"], r["post_id"]) == (1, 10)), key=lambda r: r["part"])
    assert [len(r["comments"]) for r in hot] == [10, 10, 5]
    assert [c["text"] for r in hot for c in r["comments"]] == [f"c{i}" for i in range(25)]
    rest = {(r["page_id"], r["post_id"]): (r["index"], [c["text"] for c in r["comments"]]) for r in nested if r not in hot}
    assert rest == {(1, 11): (1, []), (2, 10): (0, ["d"])}
    assert post_comments(posts, comments).count() == 25 + 1 + 2


def test_nesting_of_odd_ids(spark):
    """Sparse, repeated and null ids: nothing is lost, the post text comes out once, parts keep their bound."""
    posts = spark.createDataFrame([(1, 10, "p"), (None, 5, "n")], "page_id bigint, post_id bigint, post_content string")
    ids = [20000, 20001, 90000, None, None, 7, 7, 1 << 60]
    comments = spark.createDataFrame([(1, 10, c, f"c{i}") for i, c in enumerate(ids)], "page_id bigint, post_id bigint, comment_id bigint, comment_content string")
    assert len([r for r in nest_comments(posts, comments).collect() if r["post_id"] == 10]) == 1
    parts = nest_comments(posts, comments, size=3)
    assert sorted(len(r["comments"]) for r in parts.collect()) == [0, 2, 3, 3]
    texts = unnest_texts(parts.selectExpr("post_id AS doc_id", "part", "post_content AS status", "comments")).collect()
    assert sorted(r["text"] for r in texts) == sorted([f"c{i}" for i in range(len(ids))] + ["p", "n"])
    for size in (1_000_000, 3):
        joined = split_left_join(posts, comments, ["page_id", "post_id"], size).collect()
        assert sorted(str(r["comment_content"]) for r in joined) == sorted([f"c{i}" for i in range(len(ids))] + ["None"])


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, 0, 5), (None, 1, 6), (1, 0, 7)], "g bigint, pos bigint, v bigint")
    assert {(r["g"], r["pos"]): r["s"] for r in running_sum(df, ["g"], "pos", F.col("v"), "s").collect()} == {(None, 0): 0, (None, 1): 5, (1, 0): 0}
    assert {(r["g"], r["pos"]): r["rank"] for r in global_rank(df, [F.col("pos")], ["g"]).collect()} == {(None, 0): 1, (None, 1): 2, (1, 0): 1}


def test_bad_dates_are_null(spark):
    df = spark.createDataFrame([("2016-01-02T10:00",), ("soon",)], "d string")
    assert [str(r[0])[:10] for r in df.select(parse_date(F.col("d"))).collect()] == ["2016-01-02", "None"]


def test_lexicon_hand_worked(spark):
    rows = [(1, "n", "1", 0.5, 0.0, "tốt#1", "g"), (2, "n", "2", 0.0, 0.25, "rất tốt#1 tốt#2", "g"), (3, "x", "3", 1.0, 0.0, "tốt#bad lạ#0", "g")]
    synsets = spark.createDataFrame(rows, "line bigint, pos string, id string, pos_score double, neg_score double, synset_terms string, gloss string")
    scores = {(r["term"], r["pos"]): r["score"] for r in S.term_scores(synsets).collect()}
    assert scores == {("tốt", "n"): pytest.approx(0.25), ("rất_tốt", "n"): pytest.approx(-0.25)}


@pytest.mark.parametrize("inline", [1000, 0])
def test_sentence_scores_hand_worked(spark, words_df, inline):
    texts = [(1, "neg good ok"), (2, "neg neg good"), (3, "neg mid good"), (4, "none"), (5, "neg  good"), (6, "good ok ok")]
    df = spark.createDataFrame(texts, "id bigint, t string")
    scores = spark.createDataFrame([("good", 0.5), ("ok", 0.25), ("neg", 0.9)], "word string, score double")
    got = {r["id"]: r["score"] for r in S.sentence_scores(df, "id", "t", scores, words_df(["neg"]), inline).collect()}
    assert got == {1: -0.13, 2: -0.5, 3: 0.5, 4: 0.0, 5: 0.5, 6: 0.33}
    tiny = spark.createDataFrame([(1, "a b b")], "id bigint, t string")
    cents = spark.createDataFrame([("a", -0.03), ("b", 0.01)], "word string, score double")
    assert str(S.sentence_scores(tiny, "id", "t", cents, words_df(["neg"]), inline).first()["score"]) == "0.0"


@pytest.mark.parametrize("inline", [1000, 0])
def test_gate_and_labels(spark, words_df, inline):
    df = spark.createDataFrame([(1, ["a", "hay"]), (2, ["b"])], "id bigint, t array<string>")
    assert {r["id"]: r["gated_in"] for r in S.has_opinion(df, "id", "t", words_df(["hay"]), inline).collect()} == {1: True, 2: False}
    cases = spark.createDataFrame([(True, 0.0), (True, 1.0), (False, 1.0), (True, None)], "g boolean, p double")
    assert [r[0] for r in cases.select(S.label_of(F.col("g"), F.col("p"))).collect()] == [-1, 1, 0, 0]


@pytest.fixture(scope="module")
def trained(spark, words_df, pairs_df):
    rows = [(i, 1.0 if i % 2 else 0.0, ("tuyệt vời hay " if i % 2 else "dở tệ chán ") + f"từ{i % 7}") for i in range(60)]
    model = S.train_classifier(spark.createDataFrame(rows, "doc_id bigint, label double, text string"), words_df(["là"]))
    lookups = S.Lookups(pairs_df([(":)", " hay ")]), pairs_df([]), pairs_df([("hayy", "hay")]), words_df(["là"]), words_df(["hay", "chán"]))
    return model, lookups


def test_report(spark, trained):
    rows = [(1, 0, "Phim HAYY <3", [(1, "chán quá"), (2, "bình thường"), (3, ":)")])]
    nested = spark.createDataFrame(rows, "doc_id bigint, part bigint, status string, comments array<struct<comment_id:bigint,text:string>>")
    out = S.report(nested, *trained).first()
    assert out["status"]["type"] == 1 and out["sentiment_type"] == 1 and out["status"]["text"] == "Phim HAYY  3"
    assert [c["type"] for c in out["comments"]] == [-1, 0, 1]
    raw = S.report(nested, *trained, clean=False, post_weight=1.5).first()
    assert raw["status"]["text"] == "Phim HAYY <3" and raw["sentiment_type"] == 0


def test_weak_labels(spark, trained):
    df = spark.createDataFrame([(1, "HAY quá đi thôi 5"), (2, "hay"), (3, "không rõ gì cả"), (4, "phim này chán lắm")], "id bigint, text string")
    labelled = S.label_candidates(df, "id", "text", *trained)
    assert {r["id"]: r["label"] for r in labelled.collect()} == {1: 1, 3: 0, 4: -1}
    assert sorted((r["label"], r["text"]) for r in S.weak_labels(labelled).collect()) == [(0, "phim này chán lắm"), (1, "hay quá đi thôi  ")]


def test_topics(spark, words_df, monkeypatch):
    rng = random.Random(2)
    themes = [["bóng", "sân_cỏ", "bàn_thắng", "cầu_thủ"], ["nấu_ăn", "món_ngon", "gia_vị", "công_thức"]]
    rows = [(i, " ".join(rng.choice(themes[i % 2]) for _ in range(12))) for i in range(30)]
    docs = P.topic_tokens(spark.createDataFrame(rows, "doc_id bigint, t string"), "doc_id", "t", words_df(["gia_vị"]))
    terms = P.vocabulary_index(P.term_counts(docs))
    bags = P.bags_of_words(docs, "doc_id", terms)
    fitted = P.fit_topics(bags, terms, ks=[2, 3], iterations=8)
    again = P.fit_topics(bags, terms, ks=[2, 3], iterations=8)
    assert fitted.k in (2, 3) and fitted.log_likelihoods == pytest.approx(again.log_likelihoods)
    assert fitted.log_likelihoods[fitted.k] == max(fitted.log_likelihoods.values())
    weights = P.topic_weights(fitted, bags, "doc_id")
    sums = weights.groupBy("doc_id").agg(F.sum("weight").alias("s")).collect()
    assert len(sums) == 30 and all(r["s"] == pytest.approx(1) for r in sums)
    assert P.describe_topics(fitted, 3).count() == 3 * fitted.k
    top = P.top_documents(weights, "doc_id", P.documents_per_topic(30, fitted.k))
    assert top.groupBy("topic_id").count().where(f"count != {30 // fitted.k + 3}").isEmpty()
    monkeypatch.setattr(P, "VECTORISER_TERMS", 0)
    joined = {r["doc_id"]: r["features"] for r in P.bags_of_words(docs, "doc_id", terms).collect()}
    assert joined == {r["doc_id"]: r["features"] for r in bags.collect()}


def test_topic_queries_search_all_topic_counts(monkeypatch):
    from types import SimpleNamespace

    from chatterloom.functions import fixed_values as V
    from chatterloom.plans import top

    asked, fit = [], top.P.fit_topics

    def noted(bags, vocabulary, ks=fit.__defaults__[0], iterations=fit.__defaults__[1], seed=0):
        asked.append((list(ks), iterations))

    names = ("topic_tokens", "term_counts", "vocabulary_index", "bags_of_words")
    for name in names:
        monkeypatch.setattr(top.P, name, lambda *a: None)
    monkeypatch.setattr(top.P, "fit_topics", noted)
    monkeypatch.setattr(top, "cut_lineage", lambda df: SimpleNamespace(count=lambda: 0))
    monkeypatch.setattr(top, "table", lambda *a: SimpleNamespace(select=lambda *c: None))
    monkeypatch.setattr(top, "stop_words", lambda spark: None)
    monkeypatch.setattr(top, "F", SimpleNamespace(concat_ws=lambda *a: SimpleNamespace(alias=lambda n: None), col=lambda n: SimpleNamespace(cast=lambda t: None)))
    top._fitted(None, "")
    assert asked == [(list(V.TOPIC_COUNTS), V.LDA_ITERATIONS)]
