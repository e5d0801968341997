"""What is moved between tasks: texts instead of their pieces, shared terms only, lines not at all."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from chatterloom.operators import corpus as C
from chatterloom.operators import ngram as N
from chatterloom.operators import sentiment as S
from chatterloom.operators import topic_fit as T
from chatterloom.operators import topics as P
from chatterloom.operators.scale import cut_lineage, in_order
from chatterloom.operators.tokenize import token_line
from chatterloom.plans import cor, lm, tok, txt
from chatterloom.sinks import text as sinks
from chatterloom.sources import files

TEXTS = [(3, "one two. Three one"), (1, "two one two! a b"), (2, None), (1, "again a b"), (None, "b two one."), (7, "")]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def exchanges(df):
    """Shuffles of a plan; results of counting jobs and broadcasts are none."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return sum(" Exchange " in f" {line.strip(' +-:*')} " for line in plan.splitlines())


def test_ranges_hold_their_characters(spark):
    rows = spark.createDataFrame([(i, "x" * 100) for i in range(400)], "id long, text string")
    parts = in_order(rows, "id", "text", chars=2_000)
    assert parts.rdd.getNumPartitions() == 20
    sizes = [len(p) for p in parts.rdd.glom().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 60


def test_pieces_of_texts_do_not_move(spark, folder):
    """Only the texts are shuffled, whatever is grouped or sorted by document afterwards."""
    tokens = tok.tagged_tokens(spark, folder, txt.documents_in_order)
    assert exchanges(sinks.token_lines(tokens).orderBy("doc_id", "pos")) == 1
    assert exchanges(sinks.sentence_records(tokens, ["doc_id"], ["pos"]).orderBy("doc_id")) == 1
    assert exchanges(token_line(tokens.withColumn("part", F.lit(0)), "doc_id").orderBy("doc_id")) == 1
    assert exchanges(C.rebuild_sentences(cor.token_rows(spark, folder), ["doc_id"])) == 1
    lines = lm.token_arrays(spark, folder, txt.documents_in_order).select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    assert exchanges(N.bigram_counts_of_lines(lines, ["doc_id"], "pos", "token")) == 2


def test_lines_are_ranked_where_they_are_read(spark, tmp_path):
    for name, lines in (("b", ["x", "y"]), ("a", ["p", "", "q"]), ("c", ["z"])):
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
    found = files.read_corpora(spark, str(tmp_path), rank="rank")
    assert [(r["rank"], r["pos"], r["token"]) for r in found.orderBy("rank").collect()] == [
        (1, 0, "p"), (2, 1, ""), (3, 2, "q"), (4, 0, "x"), (5, 1, "y"), (6, 0, "z")
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    texts = files.read_texts(spark, str(tmp_path), rank="rank")
    assert sorted(tuple(r) for r in texts.select("rank", "text").collect()) == [(1, "p"), (2, ""), (3, "q"), (4, "x"), (5, "y"), (6, "z")]


def test_terms_of_one_block_stay(spark, monkeypatch):
    """A pass moves the sums of terms that several blocks share, and one row of totals for the others."""
    monkeypatch.setattr(T, "BLOCK_ENTRIES", 3)
    docs = [{0: 1, 1: 2}, {0: 1, 2: 1}, {0: 3, 3: 1}, {4: 1, 5: 1}]
    bags = spark.createDataFrame([(i, SparseVector(9, sorted(d.items()))) for i, d in enumerate(docs)], ["doc_id", "features"]).coalesce(1)
    m = T.Models((2, 3), 9, 0, shard=2)
    blocks, reach = T.with_own_terms(cut_lineage(T.blocks_of(P._entries(bags))))
    own = {r["block"]: r["own"] or [] for r in blocks.collect()}
    assert len(own) > 1 and reach == 1 and sorted(t for x in own.values() for t in x) == [1, 2, 3, 4, 5]
    rows = [r.asDict() | {"own": np.array(r["own"] or [], np.int64).tobytes()} for r in blocks.collect()]
    told = [x.to_pylist()[0] for x in T._emitted(m, ((b, *b.summed(b.start(m))) for b in map(T.Bags, rows)))]
    assert {r["shard"] for r in told if r["shard"] is not None} == {0, T.STAYED}
    moved = next(r for r in told if r["shard"] == 0)
    assert np.frombuffer(moved["at"], np.int64).tolist() == [0]
    assert np.frombuffer(moved["sums"]).reshape(-1, 5)[0][:2].sum() == pytest.approx(5)


@pytest.mark.parametrize("block_chars, triples", [(5, 2), (40, 7), (10_000, 10_000)])
def test_triples_move_packed(spark, block_chars, triples):
    """Bigrams and triples are no rows on their way, and the resolver says what it says over joined tables."""
    rng = np.random.default_rng(5)
    rows = [(int(i), [str(w) for w in rng.choice(["a", "b", "ç", "d\x1f", "e f", "le"], rng.integers(0, 9))]) for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, None), (61, ["one"]), (61, ["a", "b", "a", "b"])], "id int, t array<string>").repartition(5)
    made = F.expr("transform(sequence(0, greatest(size(t) - 3, 0)), i -> struct(get(t, i) AS first, get(t, i + 1) AS second, get(t, i + 2) AS third))")
    wanted = docs.select(F.inline(made)).where("third IS NOT NULL").distinct()
    counts = N.unigram_counts(docs.select(F.explode("t").alias("token")))
    joined = N.resolve_ambiguities(wanted, N.conditional_probability(N.bigram_counts(docs, "t"), counts), counts)
    found = N.resolve_ambiguities_of_texts(docs, "t", counts, block_chars=block_chars, triples=triples)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, joined.collect()))
    none = N.resolve_ambiguities_of_texts(docs.where("id > 99"), "t", counts.where("freq < 0"))
    assert none.columns == joined.columns and none.isEmpty()


def test_resolver_moves_less_than_a_copy_of_the_triples(spark, tmp_path):
    texts = [(i, " ".join(f"w{(i * 31 + k * k) % 97}" for k in range(40))) for i in range(50)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = lm.lm_09(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[first" not in plan and "(first" not in plan


@pytest.mark.parametrize("block", [1, 30, 10_000])
def test_words_and_pairs_are_counted_in_blocks(spark, block):
    """One row per word or pair of a block reaches the shuffle, and the counts are those of single words."""
    rng = np.random.default_rng(3)
    lines = lambda: "|".join(" ".join(rng.choice(["a", "é", "b\u00a0c"], rng.integers(0, 6))) for _ in range(rng.integers(1, 4)))
    texts = [None, "", "a", " a|a \n\tbc ", "|", " ", *(lines() for _ in range(40))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    wanted = Counter()
    for line in "|".join(t for t in texts if t).split("|"):
        words = re.split(r"[ \t\n]+", line.strip(" "))
        words = [w for w in words if w]
        wanted.update([*words, *map(" ".join, zip(words, words[1:]))])
    found = N.word_and_pair_counts(df, "text", "|", block=block, bucket=9)
    assert sorted(map(tuple, found.collect())) == sorted(wanted.items())
    assert N.word_and_pair_counts(df.where("text = ' '"), "text", "|").isEmpty()
    assert "explode" not in found._jdf.queryExecution().toString()


def test_odd_characters_cut_phrases_as_before(spark, tmp_path):
    texts = ["A  b\tc!d ", " -- ", "one two\n\nthree. - ,four five", None, "", "x\x00y z1z 2", "é́a İb ß ΑΣ Σ", "a - b", " . a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = tok.phrases(spark, str(tmp_path)).select(F.split("phrase", " +").alias("w"))
    n = F.size("w") - 1
    pairs = F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    plain = words.select(F.explode(F.concat("w", pairs)).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    counted = tok.word_frequencies(spark, str(tmp_path))
    assert counted.schema["freq"].dataType == plain.schema["freq"].dataType
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, plain.collect()))


def test_training_passes_run_as_many_tasks_as_cores(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(S, "cut_lineage", lambda df: df)
    fit = S.IDF.fit
    monkeypatch.setattr(S.IDF, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    rows = [(i, i % 2, f"good w{i % 7} bad w{i % 3}") for i in range(90)]
    labelled = spark.createDataFrame(rows, "doc_id long, label int, text string").repartition(30)
    S.train_classifier(labelled, spark.createDataFrame([("the",)], "word string"))
    assert seen == [spark.sparkContext.defaultParallelism]
