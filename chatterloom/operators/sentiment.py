"""Sentiment: a trained classifier behind an opinion-word gate, and a weighted lexicon."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.functions import fixed_values as V
from chatterloom.functions import text as X
from chatterloom.operators.cleaning import clean_text, normal_words, remove_stop_words
from chatterloom.operators.relational import unnest_texts
from chatterloom.operators.scale import INLINE_ROWS, broadcast_if_small, cut_lineage, kept_table, small_rows
from chatterloom.operators.tokenize import token_line, tokenize


@dataclass
class Lookups:
    """The tables a text passes on its way to a label. Without a lexicon, words are blank separated."""

    emoticons: DataFrame
    emoji: DataFrame
    spelling: DataFrame
    stop_words: DataFrame
    opinion_words: DataFrame
    lexicon: DataFrame | None = None
    frequencies: DataFrame | None = None


# --- trained classifier ---------------------------------------------------------------------------


def _word_array(text: Column) -> Column:
    return F.split(F.rtrim(text), " ")


def training_tokens(labelled: DataFrame, stop_words: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """``label, tokens``: digits blanked, lower case, stop words removed."""
    lowered = labelled.select(row_id, F.col("label").cast("double").alias("label"), F.lower(X.digits_to_blank(F.col("text"))).alias("text"))
    kept = remove_stop_words(lowered, row_id, "text", stop_words)
    return kept.select(row_id, "label", _word_array(F.col("text")).alias("tokens"))


def classifier_stages(buckets: int = V.HASH_BUCKETS, min_doc_freq: int = V.MIN_DOC_FREQ, iterations: int = V.CLASSIFIER_ITERATIONS) -> Pipeline:
    """Hashed term counts, inverse document frequency, binary logistic regression."""
    return Pipeline(
        stages=[
            HashingTF(inputCol="tokens", outputCol="counts", numFeatures=buckets),
            IDF(inputCol="counts", outputCol="features", minDocFreq=min_doc_freq),
            LogisticRegression(maxIter=iterations, regParam=0.0, fitIntercept=False),
        ]
    )


def train_classifier(labelled: DataFrame, stop_words: DataFrame, row_id: str = "doc_id") -> PipelineModel:
    """The stages fitted one after the other; texts are cut into words and counted once, all further passes read the counts.

    A pass sends one vector of sums per task, so passes run as many tasks as there are cores, whatever the size of the input.
    """
    hashing, weights, regression = classifier_stages().getStages()
    counted = hashing.transform(training_tokens(labelled, stop_words, row_id)).select("label", hashing.getOutputCol())
    counted = cut_lineage(counted).coalesce(labelled.sparkSession.sparkContext.defaultParallelism)
    weights = weights.fit(counted)
    return PipelineModel([hashing, weights, regression.fit(weights.transform(counted))])


def hashed_counts(docs: DataFrame, tokens: str = "tokens", buckets: int = V.HASH_BUCKETS) -> DataFrame:
    return HashingTF(inputCol=tokens, outputCol="counts", numFeatures=buckets).transform(docs)


def inverse_document_frequency(docs: DataFrame, row_id: str, tokens: str = "tokens", min_doc_freq: int = V.MIN_DOC_FREQ) -> DataFrame:
    """Per term: in how many documents it occurs, and log((m + 1) / (df + 1)), 0 below the minimum.

    Terms are made distinct inside their row, so counting needs no shuffle of pairs.
    """
    terms = docs.select(F.explode(F.array_distinct(tokens)).alias("term"))
    total = docs.agg(F.count("*").alias("m")).scalar()
    counted = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.when(F.col("df") >= min_doc_freq, F.log((total + 1) / (F.col("df") + 1))).otherwise(0.0)
    return counted.select("term", "df", idf.alias("idf"))


def has_opinion(df: DataFrame, row_id: str, tokens: str, opinion_words: DataFrame, inline_rows: int = INLINE_ROWS) -> DataFrame:
    """Flag ``gated_in``: does the row use any opinion word? False for null tokens."""
    opinion_words = normal_words(opinion_words)
    words = small_rows(opinion_words, inline_rows)
    if words is not None:
        listed = [r["word"] for r in words]
        return df.withColumn("gated_in", F.coalesce(F.exists(tokens, lambda t: t.isin(listed)), F.lit(False)))
    hits = (
        df.select(F.col(tokens).alias("_tokens")).distinct()
        .select("_tokens", F.explode("_tokens").alias("_w"))
        .join(opinion_words.select(F.col("word").alias("_w")), "_w", "left_semi")
        .select("_tokens", F.lit(True).alias("gated_in"))
        .distinct()
    )
    return df.join(hits, df[tokens] == hits["_tokens"], "left").withColumn("gated_in", F.coalesce("gated_in", F.lit(False))).drop("_tokens")


def label_of(gated_in: Column, prediction: Column) -> Column:
    """0 without opinion word or prediction, else -1 or 1."""
    predicted = F.when(prediction == 0, -1).when(prediction == 1, 1)
    return F.when(gated_in, F.coalesce(predicted, F.lit(0))).otherwise(0)


def score_type(score: Column) -> Column:
    """Positive 1, negative -1, neutral 0."""
    return F.signum(score).cast("int")


def classify(texts: DataFrame, row_id: str, text: str, model: PipelineModel, lookups: Lookups) -> DataFrame:
    """Adds ``label`` to texts whose words are blank separated: stop words go, then the rest is lower-cased."""
    kept = remove_stop_words(texts.withColumn("_t", F.col(text)), row_id, "_t", lookups.stop_words)
    kept = kept.withColumn("tokens", _word_array(F.lower("_t")))
    gated = has_opinion(kept, row_id, "tokens", lookups.opinion_words)
    labelled = model.transform(gated).withColumn("label", label_of(F.col("gated_in"), F.col("prediction")))
    return labelled.select(*texts.columns, "label")


def _tokenised(texts: DataFrame, row_id: str, text: str, lookups: Lookups) -> DataFrame:
    """Text as blank-separated words, underscores inside words."""
    if lookups.lexicon is None:
        return texts
    lines = token_line(tokenize(texts, row_id, text, lookups.lexicon, lookups.frequencies), row_id)
    renamed = lines.withColumnRenamed("text", "_line")
    return texts.join(renamed, row_id, "left").withColumn(text, F.coalesce("_line", F.lit(""))).drop("_line")


def analyse_texts(
    texts: DataFrame, row_id: str, text: str, model: PipelineModel, lookups: Lookups, clean: bool = True
) -> DataFrame:
    """Clean, tokenise, drop stop words, lower-case and classify; the given text column stays as it was.

    Capitals live until the words are found: emoticons such as ``:D``, names and titles need them. Only the variant without
    cleaning lower-cases first.
    """
    work = texts.withColumn("_work", F.col(text) if clean else F.lower(F.col(text)))
    if clean:
        work = clean_text(work, row_id, "_work", lookups.emoticons, lookups.emoji, lookups.spelling)
        work = work.withColumn("_work", X.urls_and_symbols_to_blank(X.digits_to_blank(F.col("_work"))))
    work = _tokenised(work, row_id, "_work", lookups)
    return classify(work, row_id, "_work", model, lookups).drop("_work")


def report(
    nested: DataFrame, model: PipelineModel, lookups: Lookups, clean: bool = True, post_weight: float = 1.0
) -> DataFrame:
    """One record per post: labelled text, labelled comments and the overall type.

    ``clean=False, post_weight=1.5`` gives the variant that keeps texts as they are and weighs
    the post. A post with very many comments keeps its parts, as nested.
    """
    texts = unnest_texts(nested, ["doc_id", "part"]).withColumn(
        "_id", F.concat_ws("/", "doc_id", "kind", F.coalesce(F.col("comment_id").cast("string"), F.lit("")))
    )
    scored = analyse_texts(texts, "_id", "text", model, lookups, clean)
    shown = X.angle_brackets_to_blank(F.col("text")) if clean else F.col("text")
    entry = F.struct("comment_id", F.col("label").alias("type"), shown.alias("text"))
    status = F.col("kind") == "status"
    grouped = scored.groupBy("doc_id", "part").agg(
        F.first(F.when(status, F.struct(F.col("label").alias("type"), shown.alias("text"))), ignorenulls=True).alias("status"),
        F.array_sort(F.collect_list(F.when(~status, entry))).alias("comments"),
        F.max(F.when(status, F.col("label"))).alias("_post"),
    )
    return grouped.select("doc_id", "part", "status", "comments", score_type(F.col("_post") * post_weight).alias("sentiment_type"))


def training_candidates(texts: DataFrame, row_id: str, text: str, lookups: Lookups) -> DataFrame:
    """Comments cleaned for weak labelling; those of fewer than eight characters are left out."""
    lowered = texts.withColumn(text, F.lower(F.col(text)))
    cleaned = clean_text(lowered, row_id, text, lookups.emoticons, lookups.emoji, lookups.spelling)
    plain = cleaned.withColumn(text, X.urls_to_blank(X.digits_to_blank(F.col(text))))
    return plain.where(F.length(text) >= V.MIN_TRAINING_CHARS)


def label_candidates(texts: DataFrame, row_id: str, text: str, model: PipelineModel, lookups: Lookups) -> DataFrame:
    """``training_candidates`` with their ``label``."""
    candidates = training_candidates(texts, row_id, text, lookups)
    return analyse_texts(candidates, row_id, text, model, lookups, clean=False)


def weak_labels(labelled: DataFrame, text: str = "text") -> DataFrame:
    """Training rows: neutral texts dropped, negative becomes 0."""
    return labelled.where("label != 0").select(F.when(F.col("label") == -1, 0).otherwise(F.col("label")).alias("label"), F.col(text).alias("text"))


def label_share(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Percent of rows per label; labels are few, rows are combined before the shuffle."""
    counts = labelled.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = labelled.agg(F.count("*").alias("n")).scalar()
    percent = F.round((F.col("n") * 100).cast("decimal(28,6)") / total, 0).cast("int")
    return counts.select("label", percent.alias("percent"))


# --- weighted lexicon --------------------------------------------------------------------------------


def synset_terms(synsets: DataFrame, line: str = "line") -> DataFrame:
    """``term, pos, rank, score, line, at``: one row per ranked term of each synset.

    A piece without ``#`` belongs to the next ranked term, joined by an underscore. The pieces are
    folded inside their row.
    """
    state = "struct<prefix:string,found:array<string>>"
    start = F.struct(F.lit("").alias("prefix"), F.array().alias("found")).cast(state)

    def step(acc: Column, piece: Column) -> Column:
        ranked = F.struct(F.lit("").alias("prefix"), F.array_append(acc["found"], F.concat(acc["prefix"], piece)).alias("found"))
        open_ = F.struct(F.concat(acc["prefix"], piece, F.lit("_")).alias("prefix"), acc["found"].alias("found"))
        return F.when(F.contains(piece, F.lit("#")), ranked.cast(state)).otherwise(open_.cast(state))

    found = F.aggregate(F.split("synset_terms", " "), start, step, lambda acc: acc["found"])
    rows = synsets.select("pos", line, (F.col("pos_score") - F.col("neg_score")).alias("score"), F.posexplode(found).alias("at", "ranked"))
    parts = F.split("ranked", "#")
    split = rows.select(
        F.get(parts, F.lit(0)).alias("term"), "pos", F.get(parts, F.lit(1)).try_cast("int").alias("rank"), "score", line, "at"
    )
    return split.where("rank > 0")


def term_scores(synsets: DataFrame, line: str = "line") -> DataFrame:
    """``term, pos, score``: rank-weighted mean of synset scores; a repeated rank counts once, the last one."""
    last = synset_terms(synsets, line).groupBy("term", "pos", "rank").agg(F.max_by("score", F.struct(line, "at")).alias("score"))
    weight = 1.0 / F.col("rank")
    return last.groupBy("term", "pos").agg((F.sum(F.col("score") / F.col("rank")) / F.sum(weight)).alias("score"))


def word_scores(terms: DataFrame) -> DataFrame:
    """``word, score``: sum over nouns, adjectives, adverbs and verbs."""
    scored = terms.where(F.col("pos").isin(*V.SCORED_PARTS_OF_SPEECH))
    return scored.groupBy(F.col("term").alias("word")).agg(F.sum("score").alias("score"))


def opinion_word_list(terms: DataFrame) -> DataFrame:
    """All ``term#pos`` keys."""
    return terms.select(F.concat("term", F.lit("#"), "pos").alias("entry")).distinct()


def sentence_scores(
    texts: DataFrame,
    row_id: str,
    text: str,
    scores: DataFrame,
    negations: DataFrame,
    inline_rows: int = INLINE_ROWS,
) -> DataFrame:
    """Mean of the non-zero word scores of each text, to two decimals, halves away from zero.

    A negation word counts nothing and flips the word after it. Each word learns its predecessor
    inside the row; the words of a text are combined again before the shuffle. Sums run over whole
    hundredths, so they do not depend on order.
    """
    words = F.split(text, " ")
    before = F.slice(F.concat(F.array(F.lit("")), words), 1, F.size(words))
    pairs = F.zip_with(before, words, lambda a, b: F.struct(a.alias("before"), b.alias("word")))
    rows = texts.select(row_id, F.inline(pairs))
    negations = normal_words(negations)
    listed = small_rows(negations, inline_rows)
    if listed is not None:
        names = [r["word"] for r in listed]
        rows = rows.select("*", F.col("word").isin(names).alias("_neg"), F.col("before").isin(names).alias("_flip"))
    else:
        own = negations.select("word", F.lit(True).alias("_n"))
        prior = own.select(F.col("word").alias("before"), F.col("_n").alias("_p"))
        rows = rows.join(own, "word", "left").join(prior, "before", "left")
        rows = rows.withColumn("_neg", F.coalesce("_n", F.lit(False))).withColumn("_flip", F.coalesce("_p", F.lit(False)))
    cents = F.round(F.round("score", 2) * 100, 0).cast("bigint")
    lookup = broadcast_if_small(scores.select("word", cents.alias("_c")).where("_c != 0"))
    scored = rows.where(~F.col("_neg")).join(lookup, "word")
    signed = F.when(F.col("_flip"), -F.col("_c")).otherwise(F.col("_c"))
    sums = scored.groupBy(row_id).agg(F.sum(signed).alias("_s"), F.count("*").alias("_n"))
    # Whole-number sign: a mean that rounds to zero must not become minus zero.
    mean = F.signum("_s").cast("bigint") * F.floor((2 * F.abs("_s") + F.col("_n")) / (2 * F.col("_n"))) / 100
    joined = texts.select(row_id).join(sums.select(row_id, mean.alias("_mean")), row_id, "left")
    return joined.select(row_id, F.coalesce("_mean", F.lit(0.0)).alias("score"))


def lexicon_sentiment(
    texts: DataFrame, row_id: str, text: str, scores: DataFrame, negations: DataFrame, lexicon: DataFrame, frequencies: DataFrame | None = None
) -> DataFrame:
    """Tokenise, then score with the weighted lexicon (entries of several syllables use underscores).

    The tokenised lines are written once: scoring reads them twice.
    """
    lines = kept_table(token_line(tokenize(texts, row_id, text, lexicon, frequencies), row_id))
    return sentence_scores(lines, row_id, "text", scores, negations)
