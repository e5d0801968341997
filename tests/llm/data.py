"""Small tables for the tests of this folder."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators use inside; as extra columns they must neither clash nor get lost.
EXTRA = ["size", "rank", "key", "hash", "blob", "findings", "items", "copies", "slice", "score", "kept", "rep", "node", "value"]


def edge_rows():
    """Null in each column, empty and blank texts, a very long text, ties and repeated rows."""
    word = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod".split()
    long_text = " ".join(f"{word[i % 12]}{i % 977}" for i in range(60_000))
    rows = [
        (1, "One plain text of some ten words for all of us.", "en", "a", 48),
        (1, "One plain text of some ten words for all of us.", "en", "a", 48),
        (2, None, "en", "a", 0),
        (3, "", "de", "b", 0),
        (4, " \t\n ", None, "b", 4),
        (5, "Zwei Wörter", "de", None, 11),
        (6, "One plain text of some ten words for all of us.", None, None, None),
        (None, "A text without an id, which still is a text.", "en", "a", 44),
        (None, None, None, None, None),
        (7, long_text, "en", "c", len(long_text)),
        (8, "\U0001f600 emoji \U0001f600 and é́ marks", "fr", "c", 23),
    ]
    return [r if r[4] is None or r[1] is None else (*r[:4], len(r[1])) for r in rows]


def edge_docs(spark, extra=True):
    docs = spark.createDataFrame(edge_rows(), DOCS)
    if extra:
        docs = docs.selectExpr("*", *[f"concat('x', doc_id) AS {c}" for c in EXTRA])
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def prose(seed, n, letters="abcdefgh"):
    """Invented words of two to seven letters."""
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)
