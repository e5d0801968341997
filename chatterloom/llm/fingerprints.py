"""SimHash fingerprints of documents, and a search for those within a Hamming radius.

A text is lower-cased (A-Z) and split at ASCII blanks. Its terms are all runs of up to ``WIDTH`` words that end at
each word (shorter ones only at the start), so each word adds one term and a term's weight is how often it occurs. Every term votes with the bits of
its 64-bit hash; a bit of the fingerprint is set where more than half of the weight voted for it.

Votes of two bits share one sum (32 bits each), so 32 sums over the terms suffice. They are aggregated where
the rows lie; no text is shuffled for them.

Null texts count as empty; empty and blank ones have fingerprint 0. Equal texts have equal fingerprints. Rows with a null id
come last in descending order. Repeated rows stay repeated. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.llm.shared import ascii_lower, let, text_key, words

WIDTH = 5
BITS = 64
RADIUS = 3
BLOCKS = 6
# Rows of a slice of neighbouring ids, and most slices; only the edges of the slices reach the driver.
SLICE_ROWS, MOST_SLICES = 256, 1 << 16
_GROUP = 256


def terms(text: Column, width: int = WIDTH) -> Column:
    """Hash of each word with the words before it."""
    return let(words(ascii_lower(text)), lambda w: F.transform(w, lambda x, i: F.xxhash64(*[F.get(w, i - k) for k in range(width - 1, -1, -1)])))


def _votes(term: Column) -> list[Column]:
    low = F.lit((1 << 32) | 1)
    half = BITS // 2
    return [F.sum(F.shiftrightunsigned(term, i).bitwiseAND(low)).alias(f"_v{i}") for i in range(half)] + [F.count(term).alias("_n")]


def _fingerprint() -> Column:
    """The bits from the sums that ``_votes`` made."""
    out = F.lit(0).cast("long")
    half = BITS // 2
    for i in range(half):
        for at, ones in ((i, F.col(f"_v{i}").bitwiseAND(F.lit((1 << 32) - 1))), (i + half, F.shiftrightunsigned(F.col(f"_v{i}"), 32))):
            bit = F.lit((1 << at) - (1 << 64) if at == 63 else 1 << at).cast("long")
            out = out.bitwiseOR(F.when(2 * ones > F.col("_n"), bit).otherwise(F.lit(0).cast("long")))
    return out


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_text(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def slices(docs: DataFrame) -> tuple[Column, Column, Column]:
    """(slice, is top of its slice, slice after it in ascending order or 0) of a row by its id.

    Edges are ids that occur, from an approximate quantile summary; slice k holds the ids above edge k - 1 up to edge k.
    """
    seen = docs.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    parts = max(1, min(MOST_SLICES, seen[0] // SLICE_ROWS))
    edges: list[int] = []
    if parts > 1 and seen[1] is not None:
        at = [i / parts for i in range(1, parts)]
        edges = sorted({e for e in docs.agg(F.percentile_approx("doc_id", at, 20 * parts)).first()[0] if e < seen[1]})
    doc_id = F.col("doc_id")
    if not edges:
        return F.lit(0), F.coalesce(doc_id == F.lit(seen[1]), F.lit(False)), F.lit(0)
    fine, coarse = F.lit(edges), F.lit(edges[::_GROUP])
    below = lambda some: F.size(F.filter(some, lambda e: e < doc_id))
    number = let(below(coarse), lambda c: F.when(c <= 0, 0).otherwise(_GROUP * (c - 1) + below(F.slice(fine, _GROUP * (c - 1) + 1, F.lit(_GROUP)))))
    number = F.when(doc_id.isNull(), 0).otherwise(number)
    top = (doc_id == F.lit(seen[1])) | F.array_contains(fine, doc_id)
    return number, F.coalesce(top, F.lit(False)), F.when(doc_id == F.lit(seen[1]), 0).otherwise(number + 1)


def edited_fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited, next (fingerprints as long).

    The edited text is the text with the last third of its code points replaced by the first as many of the next document
    in descending id order (after the last: the first). Each slice of ids gets a copy of the row that follows it,
    so one shuffle of the texts brings all neighbours together.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    number, top, following = slices(docs)
    own = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"), number.alias("slice"), top.alias("top"))
    where = F.when(F.col("top"), F.array(F.struct("slice", F.lit(False).alias("guest")), F.struct(following.alias("slice"), F.lit(True).alias("guest"))))
    placed = own.select("doc_id", "text", "key", F.explode(where.otherwise(F.array(F.struct("slice", F.lit(False).alias("guest"))))).alias("p"))
    placed = placed.select("doc_id", "text", "key", "p.slice", "p.guest")
    order = Window.partitionBy("slice").orderBy("guest", F.col("doc_id").desc_nulls_last(), "key")
    near = placed.select("*", F.row_number().over(order).alias("nr"), F.coalesce(F.lead("text").over(order), F.lit("")).alias("following"))
    cut = near.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("third", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("third")).cast("int")), F.substring("following", F.lit(1), F.col("third")))
    both = cut.withColumn("edited", edited).select(
        "slice", "nr", "guest", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.posexplode(F.array("text", "edited")).alias("kind", "t"),
    )
    keys = ["slice", "nr", "guest", "doc_id", "n_chars", "edited_sha256"]
    voted = both.select(*keys, "kind", F.explode_outer(terms(F.col("t"), width)).alias("term")).groupBy(*keys, "kind").agg(*_votes(F.col("term")))
    prints = voted.select(*keys, "kind", _fingerprint().alias("f")).groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == 0, F.col("f"))).alias("fingerprint"), F.max(F.when(F.col("kind") == 1, F.col("f"))).alias("edited")
    )
    follows = F.lead("fingerprint").over(Window.partitionBy("slice").orderBy("nr"))
    with_next = prints.withColumn("next", F.coalesce(follows, F.lit(0).cast("long")))
    return with_next.where(~F.col("guest")).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited", "next")


def _tables(fingerprint: Column, radius: int, blocks: int) -> Column:
    """One (table, kept bits) for each choice of blocks: ``radius`` blocks are left out, the others must agree."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    kept = [sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in kept]
    return F.array(*[F.struct(F.lit(t).alias("table"), fingerprint.bitwiseAND(F.lit(m).cast("long")).alias("bits")) for t, m in enumerate(signed)])


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, found, distance) for all distinct fingerprints of ``prints`` (column fingerprint) within the radius of one of ``queries``.

    At most ``radius`` blocks can differ, so some table agrees: no pair is missed. Each pair comes from the first
    table in which it meets.
    """
    asked = queries.select(F.col("fingerprint").alias("query")).where("query IS NOT NULL").distinct()
    there = prints.select(F.col("fingerprint").alias("found")).where("found IS NOT NULL").distinct()
    left = asked.select("query", F.explode(_tables(F.col("query"), radius, blocks)).alias("k")).select("query", "k.table", "k.bits")
    right = there.select("found", F.explode(_tables(F.col("found"), radius, blocks)).alias("k")).select("found", F.col("k.table").alias("_table"), F.col("k.bits").alias("_bits"))
    differ = F.bit_count(F.col("query").bitwiseXOR(F.col("found")))
    first = F.array_position(F.zip_with(_tables(F.col("query"), radius, blocks), _tables(F.col("found"), radius, blocks), lambda a, b: a["bits"] == b["bits"]), True) - 1
    met = left.join(right, (F.col("table") == F.col("_table")) & (F.col("bits") == F.col("_bits")) & (differ <= radius))
    return met.where(F.col("table") == first).select("query", "found", differ.alias("distance"))
