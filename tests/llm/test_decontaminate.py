import re

import pytest

from chatterloom.llm import decontaminate as dc
from tests.llm import data


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items):
    w, hit, found = split(text), set(), set()
    for item_id, item in items:
        v = split(item)
        n = min(13, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item_id)
    return len(w), len(hit), sorted(x for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w)


ITEMS = [(1, data.prose(1, 30)), (2, data.prose(2, 13)), (3, "Short ITEM"), (4, data.prose(1, 30)), (None, data.prose(3, 14)), (5, None), (6, ""), (1, data.prose(4, 15)), (7, "zz zz zz")]
TEXTS = [
    data.prose(9, 20) + " " + ITEMS[0][1].upper() + " " + data.prose(8, 400),
    "x, " + ", ".join(ITEMS[1][1].split()) + "!",
    " ".join(ITEMS[0][1].split()[5:25]),
    " ".join(ITEMS[0][1].split()[:12]),
    "a short   item, and a short-item",
    "zz zz zz zz zz zz",
    data.prose(3, 14),
    data.prose(4, 15) + " é " + data.prose(2, 13),
    "", None, "... !!",
]


@pytest.mark.parametrize("most", [200_000, 0])
def test_against_plain_search(spark, most):
    """The set of hashes and the shuffled join give the same."""
    docs = data.documents(spark, TEXTS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in dc.contamination(docs, items, max_broadcast=most).collect()}
    assert got == {i: plain(t, ITEMS) for i, t in enumerate(TEXTS)}


def test_edges_and_removal(spark):
    docs = data.edge_docs(spark)
    items = spark.createDataFrame([(1, "plain text of some")], "item_id long, text string")
    assert dc.contamination(docs, items).count() == docs.count()
    kept = dc.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in data.edge_rows() if r[0] not in (1, 6))
    none = items.limit(0)
    assert dc.without_contaminated(docs, none).count() == docs.count()
    assert dc.contamination(data.empty_docs(spark), items).count() == 0
    cut = {r.text for r in dc.without_spans(docs.where("doc_id = 1"), items).collect()}
    assert cut == {"one ten words for all of us"}
