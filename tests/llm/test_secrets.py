import random
import re

from chatterloom.llm import blob_ledger as bl
from tests.llm import data

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def texts():
    r = random.Random(3)
    parts = ["password", "API_KEY", "apikey", "token", "secret", ":", "=", " ", '"', "'", "abc", "abcdef1", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "\U0001f600", "é", "x-y", "AKIAAKIA"]
    made = ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(400)]
    return made + ["token: abc token: abcdefgh", "password: token=abcdef", "token=abcdef", "AKIA" + "A" * 16, "f" * 24, "f" * 23, "x" + "f" * 30]


def test_findings_against_python(spark):
    made = texts()
    docs = data.documents(spark, made)
    got = bl.secrets_of_paths(docs, ["doc_id"]).collect()
    assert {r.doc_id: [tuple(f) for f in r.findings] for r in got} == {i: plain(t) for i, t in enumerate(made)}
    assert sum(bool(r.findings) for r in got) > 50


def test_only_unseen_pairs_are_scanned(spark):
    first = data.documents(spark, ["token=abcdef1", "nothing", "token=abcdef1"])
    ledger = bl.scan_unseen(first)
    assert ledger.count() == 2
    second = data.documents(spark, ["token=abcdef1", "nothing", "password=zzzzzz9", None])
    assert {r.text for r in bl.unseen_blobs(second, ledger).collect()} == {"password=zzzzzz9", ""}
    assert bl.unseen_blobs(second, ledger, rule_version=2).count() == 4
    found = {r.doc_id: len(r.findings) for r in bl.secrets_of_paths(second, ["doc_id"], ledger).collect()}
    assert found == {0: 1, 1: 0, 2: 1, 3: 0}


def test_edges_and_masking(spark):
    docs = data.edge_docs(spark)
    assert bl.secrets_of_paths(docs, ["doc_id"]).count() == docs.count()
    assert sorted(map(str, bl.redact_documents(docs).collect())) == sorted(map(str, docs.collect()))
    assert bl.redact_documents(data.empty_docs(spark)).count() == 0
    made = ["é token=" + "a" * 30 + " end", "none"]
    masked = {r.doc_id: (r.text, r.n_chars) for r in bl.redact_documents(data.documents(spark, made)).collect()}
    assert masked == {0: ("é [SECRET] end", len("é [SECRET] end")), 1: ("none", 4)}


def test_texts_move_only_if_copied(spark, monkeypatch):
    made = ["token=abcdef1", "nothing", "token=abcdef1", None, "", "alone"]
    docs = data.documents(spark, made)
    want = sorted(["token=abcdef1", "nothing", "", "alone"])
    hidden = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    blobs = bl.unseen_blobs(docs, None)
    assert sorted(r.text for r in blobs.collect()) == want
    # Single texts pass an anti join with the copied blobs, copies alone are grouped.
    assert "LeftAnti" in hidden(blobs) and "LeftSemi" in hidden(blobs)
    masked = bl.redact_documents(docs)
    assert "broadcast" in hidden(masked)
    few = sorted(map(str, masked.collect()))
    monkeypatch.setattr(bl, "SENT_BLOBS", 0)
    monkeypatch.setattr(bl, "SENT_FINDINGS", 0)
    assert sorted(r.text for r in bl.unseen_blobs(docs, None).collect()) == want
    assert sorted(map(str, bl.redact_documents(docs).collect())) == few
    assert sum("[SECRET]" in r for r in few) == 2
