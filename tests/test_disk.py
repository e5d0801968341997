"""What lies on disk while a query runs: nothing that no one reads any more."""

import glob
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatterloom.operators import graph as G
from chatterloom.operators import segment as S
from chatterloom.operators import tokenize as M
from chatterloom.operators import topic_fit as T
from chatterloom.operators import topics as P
from chatterloom.operators.scale import broadcast_if_small, cut_lineage, discard, kept_table, with_entries
from chatterloom.session import ensure_checkpoint_dir
from tests.test_topic_fit import corpus, table


def cut_tables(spark):
    ensure_checkpoint_dir(spark)
    return set(glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/rdd-*"))


@pytest.mark.parametrize("sent", [8_000_000, 200, 0])
def test_passes_over_topics_do_not_pile_up(spark, monkeypatch, sent):
    """However many passes, the same few tables are left; all models together, in groups and alone."""
    monkeypatch.setattr(T, "SENT_CELLS", sent)
    bags, vocabulary = table(spark, corpus(docs=20))
    left = []
    for iterations in (1, 4):
        before = cut_tables(spark)
        fitted = P.fit_topics(bags, vocabulary, ks=[2, 3, 4], iterations=iterations)
        left.append(len(cut_tables(spark) - before))
        assert fitted.masses.keys() == {2, 3, 4} and len({round(x) for x in fitted.masses.values()}) == 1
        assert P.training_weights(fitted, "doc_id").count() == 20 * fitted.k
    assert left[0] == left[1] <= 4


def test_groups_of_models_begin_where_all_begin(monkeypatch):
    monkeypatch.setattr(T, "SENT_CELLS", 50)
    m = T.Models((2, 3, 4, 9, 2), 10, 7)
    groups = m.groups(10)
    assert [g.ks for g in groups] == [(2, 3), (4,), (9,), (2,)] and [g.before for g in groups] == [0, 5, 9, 18]
    assert [g.ks for g in m.groups(2)] == [(2, 3, 4, 9, 2)]
    bags = T.Bags({"uid": np.array([0]).tobytes(), "seed": np.array([5]).tobytes(), "size": np.array([2]).tobytes(), "idx": np.array([1, 3]).tobytes(), "n": np.ones(2).tobytes()})
    assert np.array_equal(np.hstack([bags.start(g) for g in groups]), bags.start(m))


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}


@pytest.mark.parametrize("write", [cut_lineage, kept_table])
def test_shuffle_files_end_with_the_table_they_were_made_for(spark, write):
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffle_files(spark)
    made = write(counted)
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not left and made.count() == 7


def test_discarded_tables_leave_no_files(spark):
    kept = cut_lineage(spark.range(10))
    here = cut_tables(spark)
    discard(kept)
    assert len(here - cut_tables(spark)) == 1


def test_tokens_move_packed_to_their_dates(spark):
    """No window over single tokens; null and repeated keys are keys, null tokens join nothing."""
    words = {"day": ("of",), "month": ("in",), "year": ("the",)}
    rows = [(k, i, t, r) for k in (1, None, 2) for i, (t, r) in enumerate([("of", "w"), ("1/2", "date_dd-mm"), (None, "w"), ("in", "w"), ("3/2016", "date_mm-yyyy"), ("the", "w")])]
    rows += [(2, 6, "7", "number1"), (3, 0, "7", "number1"), (4, 0, "of", "w"), (5, 0, None, None)]
    df = spark.createDataFrame(rows, "id long, pos int, token string, rule string").repartition(5)
    merged = M.merge_dates(df, ["id"], ["pos"], words)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "content" in plan and merged.columns == df.columns
    own = [(1, "of 1/2"), (2, None), (4, "in 3/2016")]
    assert sorted(((r["id"] or 0, r["pos"], r["token"] or "") for r in merged.collect())) == sorted(
        [(k, p, t or "") for k in (0, 1) for p, t in [*own, (5, "the")]] + [(2, p, t or "") for p, t in own] + [(2, 6, "the 7"), (3, 0, "7"), (4, 0, "of"), (5, 0, "")]
    )


def test_frequencies_that_are_counted_leave_no_shuffle_files(spark):
    freq = spark.range(100).groupBy((F.col("id") % 50).alias("k")).count()
    before = shuffle_files(spark)
    broadcast_if_small(freq, 5)
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not left


def test_choices_are_resolved_without_rows_for_their_words(spark):
    listed = spark.createDataFrame([(i, c, ws) for i in range(9) for c, ws in enumerate([["a b", "c"], ["a", "b c", "d"], []])], "id long, choice int, words array<string>")
    freq = spark.createDataFrame([("a b", i) for i in range(4)] + [("b c", 9), ("z", None)], "word string, freq long")
    found = S.resolve(listed, ["id"], freq)
    assert "explode" not in found._jdf.queryExecution().toString()
    assert {tuple(r) for r in found.select("id", "freq", F.array_join("words", "|")).collect()} == {(i, 9, "a|b c|d") for i in range(9)}


def test_blocks_and_lookups_move_compressed(spark):
    """Rows of every kind come back as they were, beside the entries of their block; words without entries find nothing."""
    rows = spark.createDataFrame([(i, None if i % 3 else f"w{i}", [f"w{i}", None, "x\ny"]) for i in range(30)], "id long, name string, words array<string>").repartition(3)
    entries = spark.createDataFrame([(f"w{i}", i) for i in range(0, 30, 2)] + [(None, 5), ("x\ny", 7)], "word string, n long")

    def work(rows, found):
        known = dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist()))
        made = [sum(known.get(w, 0) for w in ws) for ws in rows.column("words").to_pylist()]
        return pa.table({"id": rows.column("id"), "name": rows.column("name"), "n": pa.array(made, pa.int64())})

    for chars, bucket in ((1, 1), (7, 50), (1000, 1000)):
        found = with_entries(rows, F.lit(1), F.col("words"), entries, work, rows.select("id", "name", F.lit(1).cast("long").alias("n")).schema, chars, bucket_chars=bucket)
        assert sorted(map(tuple, found.collect())) == [(i, None if i % 3 else f"w{i}", 7 + (0 if i % 2 else i)) for i in range(30)]
    assert "_block" not in found._jdf.queryExecution().toString()


def test_closure_keeps_compressed_tables_only(spark):
    """One checkpoint for the links, none for a round."""
    vertices = spark.range(7)
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    before = cut_tables(spark)
    pairs = G.transitive_closure(vertices, edges)
    assert len(cut_tables(spark) - before) <= 1
    assert sorted(map(tuple, pairs.collect())) == [(a, b) for a in range(7) for b in range(a, 7)]
