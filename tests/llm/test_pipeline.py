import random
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import data
from tests.llm.test_secrets import plain as secrets_of
from tests import oracle

SF_DIR = "/root/testdata/sf0.001"


def made_documents():
    """Clean, toxic, copied, contaminated and secret-bearing documents, and the ids of each kind."""
    r = random.Random(11)
    item = data.prose(999, 20)
    rows, kinds = [], {}
    for i in range(400):
        text, kind = data.prose(i, 60), "clean"
        if i % 5 == 1:
            text, kind = f"dolt {text} dolt", "toxic"
        elif i % 40 == 2:
            text, kind = f"{data.prose(i, 5)} {item}", "contaminated"
        elif i % 40 == 3:
            text, kind = f"{text} password = {data.prose(i, 1)}12345678 {data.prose(i + 1, 5)}", "secret"
        elif i % 40 == 4:
            w = data.prose(i - 4, 60).split()
            w[30] = "changed"
            text, kind = " ".join(w), "copy"
        kinds[i] = kind
        rows.append((i, text, "en", f"s{r.randrange(3)}", len(text)))
    return rows, kinds, item


def test_stages(spark, tmp_path):
    rows, kinds, item = made_documents()
    d = str(tmp_path)
    spark.createDataFrame(rows, data.DOCS).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int(k == "toxic")) for i, k in kinds.items()]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    gone = {"toxicity": "toxic", "minhash_near_dedup": "copy", "benchmark_decontamination": "contaminated"}
    alive = set(kinds)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        docs = spark.createDataFrame(out.collect(), out.schema)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == [c.split()[0] for c in data.DOCS.split(", ")]
            alive -= {i for i in alive if kinds[i] == gone.get(name)}
            if name == "minhash_near_dedup":  # contaminated documents share their passage only
                assert {x.doc_id for x in docs.collect()} <= alive
            else:
                assert {x.doc_id for x in docs.collect()} == alive
    texts = {i: t for i, t, *_ in rows}
    for x in docs.collect():
        assert x.mix_copies > 0
        want = texts[x.doc_id]
        for a, _, b, _ in reversed(secrets_of(want)):
            want = f"{want[:a]}[SECRET]{want[b:]}"
        assert x.text == want and x.n_chars == len(want)
        assert (kinds[x.doc_id] == "secret") == ("[SECRET]" in x.text)


def test_run_is_the_query():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", name)) for name in entry.queries()) == 1


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_edges(spark, tmp_path, stage):
    d = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (7, 1, 1), (None, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, data.prose(1, 20)), (None, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    docs = data.edge_docs(spark)
    out = run(spark, docs, d)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert out.count() <= docs.count()
    assert run(spark, data.empty_docs(spark), d).count() == 0


@pytest.mark.parametrize("name", [n for n in entry.LLM_SQL])
def test_against_sql(spark, name):
    good, message = oracle.compare(spark, oracle.connect(SF_DIR), name, entry.queries()[name], entry.LLM_SQL[name], SF_DIR)
    assert good, message
