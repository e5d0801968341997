import json
import os
import random

import pytest
from pyspark.sql import functions as F

from chatterloom.operators import directories, lexer, ngram
from chatterloom.operators import sentiment as S
from chatterloom.operators.corpus import line_differences, rebuild_sentences
from chatterloom.sinks import store
from chatterloom.sinks import text as sinks
from chatterloom.sources import files, graphs, tables
from chatterloom.streaming.scoring import score_stream, stream_texts


def put(folder, name, content):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(content)
    return path


def test_pairs(spark, tmp_path):
    path = put(tmp_path, "d.txt", "ko\tkhông\nbad line\n^^\t thẹn \n^^\t vui \nx\ty\tz\n")
    assert dict(map(tuple, files.read_pairs(spark, path).collect())) == {"ko": "không", "^^": " vui ", "x": "y"}


def test_lists_and_training(spark, tmp_path):
    path = put(tmp_path, "n.txt", "chưa\r\nđâu \r\n\r\nchưa\r\n")
    assert sorted(r[0] for r in files.read_word_list(spark, path).collect()) == ["chưa", "đâu"]
    path = put(tmp_path, "t.txt", "1\thay\n0\tdở\nx\tsai\n")
    assert sorted(map(tuple, files.read_training_text(spark, path).collect())) == [(0.0, "dở"), (1.0, "hay")]


def test_line_numbers_across_splits(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    lines = [f"dòng {i % 13}" for i in range(400)]
    put(folder, "a.txt", "\n".join(lines) + "\n")
    put(folder, "b.txt", "x\ny\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        splits = files.read_lines(spark, str(folder)).select("file", "block").distinct().count()
        assert splits > 5
        corpora = files.read_corpora(spark, str(folder))
        rows = sorted((os.path.basename(r["file"]), r["pos"], r["token"]) for r in corpora.collect())
        assert rows == [("a.txt", i, t) for i, t in enumerate(lines)] + [("b.txt", 0, "x"), ("b.txt", 1, "y")]
        pairs = ngram.bigram_counts_of_lines(corpora, ["file"], "pos", "token")
        assert pairs.where("first = ''").agg(F.sum("freq")).first()[0] == 2
        assert pairs.agg(F.sum("freq")).first()[0] == 402
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_graph_files(spark, tmp_path):
    vertices, edges = graphs.read_edges(spark, put(tmp_path, "g.txt", "4\n0 1\n1  2\n\n2 3\n"))
    assert vertices.count() == 4 and sorted(map(tuple, edges.collect())) == [(0, 1), (1, 2)]
    _, weighted = graphs.read_weighted_edges(spark, put(tmp_path, "w.txt", "3\n0 1 2.5\n1 2 1\n"))
    assert sorted(map(tuple, weighted.collect())) == [(0, 1, 2.5), (1, 2, 1.0)]
    _, matrix = graphs.read_matrix(spark, put(tmp_path, "m.txt", "3\n0 1 0\n0 0 1\n1 0 0\n"))
    assert sorted(map(tuple, matrix.collect())) == [(0, 1), (1, 2), (2, 0)]


def test_replace_pages(spark, tmp_path):
    path = str(tmp_path / "posts")
    schema = "page_id bigint, post_id bigint, post_content string"
    store.save_posts(spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "c")], schema), path, [1, 2, 3])
    store.save_posts(spark.createDataFrame([(1, 2, "ế")], schema), path, [1, 2])
    rows = sorted((r["page_id"], r["post_id"], r["post_content"]) for r in tables.read_pages_table(spark, path).collect())
    assert rows == [(1, 2, "ế"), (3, 1, "c")]
    with pytest.raises(ValueError):
        store.save_posts(spark.createDataFrame([(9, 1, "x")], schema), path, [1])


def test_a_killed_batch_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    kinds = {"posts": "post_id bigint, post_content string", "comments": "post_id bigint, comment_content string"}

    def commit(posts, comments, pages):
        made = [spark.createDataFrame(rows, f"page_id bigint, {kind}") for rows, kind in zip((posts, comments), kinds.values())]
        return store.commit_batch(*made, path, pages)

    def stored(version=None):
        return [sorted(map(tuple, store.read_committed(spark, path, kind, schema, version).select("page_id", "post_id", F.col(schema.split()[2])).collect())) for kind, schema in kinds.items()]

    assert stored() == [[], []]
    assert commit([(1, 1, "a"), (2, 1, "b")], [(1, 1, "ca")], [1, 2]) == 0
    old = [[(1, 1, "a"), (2, 1, "b")], [(1, 1, "ca")]]
    assert stored() == old
    # Killed between posts and comments, and between comments and the manifest.
    for step in (1, 2):
        calls = []

        def killed(*a, step=step, calls=calls, real=store.compose_letters):
            calls.append(a)
            if len(calls) > step:
                raise KeyboardInterrupt
            return real(*a)

        monkeypatch.setattr(store, "compose_letters" if step == 1 else "_manifest", killed if step == 1 else lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            commit([(1, 9, "new")], [(1, 9, "new")], [1])
        monkeypatch.undo()
        assert stored() == old
    assert commit([(1, 2, "x")], [], [1, 2, 3]) == 1
    assert stored() == [[(1, 2, "x")], []] and stored(0) == old
    with pytest.raises(ValueError):
        commit([(9, 1, "x")], [], [1])
    # Another writer was first.
    monkeypatch.setattr(store, "latest_version", lambda *a: 0)
    with pytest.raises(RuntimeError):
        commit([(1, 3, "late")], [], [1])
    monkeypatch.undo()
    assert stored() == [[(1, 2, "x")], []]


def test_profiles(spark, tmp_path):
    path = str(tmp_path / "profiles")
    schema = "page_id bigint, page_name string, ord int"
    store.save_profiles(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], schema), path, "ord")
    assert store.save_profiles(spark.createDataFrame([(2, "x", 2), (2, "y", 1), (3, "z", 0)], schema), path, "ord") == 1
    assert sorted(map(tuple, store.read_profiles(spark, path).select("page_id", "page_name").collect())) == [(1, "a"), (2, "x"), (3, "z")]


def test_corpus_xml(spark, tmp_path):
    rows = [(1, 1, 0, "a & b", "word"), (1, 1, 1, ".", "ponctuation"), (1, 2, 2, "\n", "return"), (1, 3, 3, "c", "word")]
    tokens = spark.createDataFrame(rows, "doc_id bigint, line int, pos int, token string, rule string")
    records = sinks.sentence_records(tokens, ["doc_id", "line"], ["pos"])
    path = str(tmp_path / "xml")
    sinks.write_corpus_xml(records, path, ["doc_id", "line"])
    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    assert '<w t="word">a &amp; b</w>' in text and text.count("<s>") == 3 and ("<p></p>" in text or "<p/>" in text)


def test_token_formats(spark):
    tokens = spark.createDataFrame([(0, "a<b", "word")], "pos int, token string, rule string")
    shown = {form: sinks.token_lines(tokens, form).first()["value"] for form in sinks.TOKEN_FORMATS}
    assert shown == {"plain": "a<b", "2cols": "a<b\tword", "xml": "<w>a&lt;b</w>"}


def test_chart_and_report(spark):
    shares = spark.createDataFrame([("x", 3), ("a", 97)], "label string, percent int")
    assert sinks.chart_json(shares).first()[0] == '[["Label", "Percent"],["a", 97],["x", 3]]'
    odd = spark.createDataFrame([('a"b', 5), ("c]\\", 7)], "label string, percent int")
    assert json.loads(sinks.chart_json(odd).first()[0]) == [["Label", "Percent"], ['a"b', 5], ["c]\\", 7]]
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "line_no bigint, line string")
    right = spark.createDataFrame([(1, "a"), (2, "x")], "line_no bigint, line string")
    report = sinks.difference_report(line_differences(left, right)).orderBy("line_no")
    assert [r["value"] for r in report.collect()] == ["# of differences = 1", "", "Line 2: b # x"]


def test_rebuild_sentences(spark):
    rows = [(1, i, t) for i, t in enumerate("a b c. d e ! f".split())]
    df = spark.createDataFrame(rows, "doc bigint, pos bigint, token string")
    out = rebuild_sentences(df, ["doc"], size=2).orderBy("sentence", "part").collect()
    assert [(r["sentence"], r["part"], r["text"]) for r in out] == [(0, 0, "a b"), (0, 1, "c."), (1, 0, "d e"), (1, 1, "!"), (2, 0, "f")]


def test_rebuild_sentences_across_blocks(spark):
    """Groups longer than a block, null groups, ends in a row and gaps between positions give what one pass gives."""
    rng = random.Random(4)
    rows = [(doc, 3 * i, rng.choice(["a", "b", "c.", "d!", "?"] if doc != 2 else ["x", "y"])) for doc in (None, 1, 2, 3) for i in range(rng.randint(30, 60))]
    df = spark.createDataFrame(rows, "doc bigint, pos bigint, token string").repartition(3)
    one, many = ({tuple(r) for r in rebuild_sentences(df, ["doc"], size=12, block=b).collect()} for b in (1_000_000, 20))
    assert one == many
    for doc in (None, 1, 2, 3):
        own = sorted((r for r in one if r[0] == doc), key=lambda r: r[1:3])
        assert " ".join(r[3] for r in own) == " ".join(t for d, _, t in sorted(rows, key=lambda r: r[1]) if d == doc)


def test_folders(spark, tmp_path, words_df):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.pos", "Anh/N đi_học/V ./.\n//SYM x/N\n")
    put(folder, "b.txt", "Anh đi học .\n")
    assert directories.untag_folder(spark, str(folder), str(tmp_path / "out")) == 1
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out" / "name=a")).collect()] == ["Anh đi_học .", "x"]
    report = directories.tokenize_folder(spark, str(folder), str(tmp_path / "tok"), words_df(["đi", "đi học"])).first()
    assert (report["n_files"], report["n_tokens"]) == (1, 3)
    assert spark.read.text(str(tmp_path / "tok" / "name=b")).first()["value"] == "Anh đi_học ."


def test_stream_equals_batch(spark, tmp_path, words_df):
    texts = spark.createDataFrame([(str(i), w) for i, w in enumerate(["neg good", "good", "bad ok", "x"] * 5)], "id string, text string")
    scores = spark.createDataFrame([("good", 0.5), ("bad", -0.5), ("ok", 0.25)], "word string, score double")
    score = lambda df: S.sentence_scores(df, "id", "text", scores, words_df(["neg"]))
    source, output = str(tmp_path / "src"), str(tmp_path / "out")
    texts.repartition(5).write.parquet(source)
    score_stream(stream_texts(spark, source, texts.schema, 2), score, output, str(tmp_path / "chk"))
    streamed = sorted(map(tuple, spark.read.parquet(output).select("id", "score").collect()))
    assert streamed == sorted(map(tuple, score(texts).select("id", "score").collect()))


def test_lines_of_tokens_are_the_grouped_tokens(spark):
    rows = [(3, "One two.\n\n12/3/2020 ok"), (1, None), (2, "a b\r\nc"), (2, "c d e\r\nb a"), (None, "x\ny"), (5, " \n"), (4, "")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lines = lexer.lex_lines(texts, "doc_id", "text")
    keys = ["doc_id", "line"]
    made = sinks.sentence_records(lines, keys, ["pos"], listed="tokens")
    expected = sinks.sentence_records(lexer.lex(texts, "doc_id", "text"), keys, ["pos"])
    order = lambda r: (r["doc_id"] or 0, r["line"])
    assert sorted(made.collect(), key=order) == sorted(expected.collect(), key=order)
    assert [order(r) for r in lines.collect()] == sorted(order(r) for r in lines.collect())
    plan = made.sortWithinPartitions(*keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1  # of the texts; nothing made of them moves
