"""What the sentiment jobs compute, and how often."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterloom.operators import sentiment as S
from chatterloom.plans import catalog, sen

WORDS = ["good", "bad", "fine", "poor", "plain"]


def test_jobs_without_tokeniser_count_no_words(spark, monkeypatch):
    def refused(spark, d):
        return spark.range(1).select(F.raise_error(F.lit("counted")).cast("string").alias("word"), F.lit(9).cast("bigint").alias("freq"))

    monkeypatch.setattr(sen, "word_frequencies", refused)
    for name in ("sen_09_training_candidates", "sen_05_labels", "sen_17_classify_lines"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_training_reads_texts_once(spark):
    rows = [(i, i % 2, " ".join(WORDS[(i * k) % 5] for k in range(1, 9)) + " 7") for i in range(60)]
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    labelled = spark.createDataFrame(rows, "doc_id long, label int, text string").repartition(3, "doc_id")
    stop_words = spark.createDataFrame([("plain",), (None,)], "word string")
    plain = S.classifier_stages().fit(S.training_tokens(labelled, stop_words))
    counting = labelled.withColumn("text", F.udf(seen, "string").asNondeterministic()("text"))
    model = S.train_classifier(counting, stop_words)
    assert read.value == len(rows)
    assert model.stages[1].idf == plain.stages[1].idf and model.stages[2].coefficients == plain.stages[2].coefficients
    tokens = S.training_tokens(labelled, stop_words)
    assert model.transform(tokens).select("doc_id", "prediction").exceptAll(plain.transform(tokens).select("doc_id", "prediction")).isEmpty()


def test_lexicon_sentiment_tokenises_once(spark, words_df):
    texts = spark.createDataFrame([(1, "a good day"), (1, "a good day"), (2, "not good"), (3, None)], "id int, text string")
    scores = spark.createDataFrame([("good", 0.5), ("day", -0.25)], "word string, score double")
    scored = S.lexicon_sentiment(texts, "id", "text", scores, words_df(["not"]), words_df(["good", "day"]))
    assert "MapInPandas" not in scored._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, scored.collect())) == [(1, 0.13), (2, -0.5)]
