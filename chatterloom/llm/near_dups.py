"""Near duplicates by a chosen-path set similarity join.

A document is the set of its word shingles. Equal sets form one class with the smallest id as its
representative. Each of ``TREES`` independent trees puts every representative under its minwise shingle; two sets of
similarity s meet there with probability s. A node is settled once few members are open (outside its largest component so
far): they are compared with all of its members. A larger node compares ``PIVOTS`` members with all others, which joins families of near
copies, and if too many are still open it branches every set on further minwise choices. The first tree runs alone; the others then
look only at nodes that still hold several components.

Pairs never become rows. Members of a node go to one task (in blocks of ``BLOCK``, the ones to compare in each), first with 128-byte
sketches: those that some sketch holds together are suspects. Only suspects send their full sets, cut into parts of
``PART`` shingles, and the exact comparison emits links between different components, fewer than its members.

At the threshold 0.8 a pair escapes ten trees with probability 0.2^10 where the first node is settled, ``escape`` gives it for deeper ones; a
pair at the threshold fails the sketch with a probability under 1e-4. No row count, depth or number of partners is capped.

Null, empty and blank texts have an empty set: they link with nothing and are their own component. Rows
without id have no component and are kept. Rows that share an id are one document, whose texts may differ: the first set counts for each
of them. Very long texts are hashed whole. Ties of hashes link nothing that the full sets don't. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.components import components, packed
from chatterloom.llm.shared import small_batches, stored
from chatterloom.operators.scale import broadcast_if_small, cut_lineage

WIDTH = 5
SIMILARITY = 80  # in hundredths
TREES = 10
SKETCH = 128
# A sketch of two sets at the threshold agrees in fewer bytes with a probability under 1e-4.
LEAST_EQUAL = 84
# Most open members of a node that are compared with all of it, for each level: deeper nodes are fewer.
SMALL = 2048
# Members of a task, besides those that are compared with all others.
BLOCK = 4096
# Members, besides one of its largest component, that a larger node compares with all of it.
PIVOTS = 8
# Shingles of suspects that meet in one comparison of full sets; twice as many where two parts meet.
PART = 1_000_000
# Minwise bytes beside the sketch that nodes may branch on.
FURTHER = 128

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 2**64, TREES + SKETCH + FURTHER, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, TREES + SKETCH + FURTHER, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def children(level: int) -> int:
    """Children of each set of a large node."""
    return 2 if level % 5 in (2, 4) else 1


def escape(depth: int, similarity: float = SIMILARITY / 100) -> float:
    """Probability that no tree holds a pair together after ``depth`` branchings, pivots ignored."""
    lost = 0.0
    for level in range(depth, 0, -1):
        lost = (1 - similarity * (1 - lost)) ** children(level)
    return (1 - similarity * (1 - lost)) ** TREES


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < 100_000:
            self[word] = value
        return value


_hash_of = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; bytes lower-case and split at ASCII characters only."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hash_of.__getitem__, found), np.uint64, len(found))
    n = min(width, len(w))
    total = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        total += w[k : len(w) - n + 1 + k] * _PLACE[k % 64] + np.uint64(k)
    return np.unique(_mixed(total))


def _minwise(s: np.ndarray) -> np.ndarray:
    """Least value of each hash function over a set, in blocks so that long texts need little memory."""
    low = np.full(len(_MULTIPLY), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 128):
        low = np.minimum(low, (s[i : i + 128, None] * _MULTIPLY + _ADD).min(axis=0))
    return low


def _set_id(s: bytes) -> bytes:
    return hashlib.blake2b(s, digest_size=16).digest()


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, set_id, tokens, sketch, further) of every row; the last four null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, tokens, sketches, further = [], [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), width)
                sizes.append(len(s))
                if len(s):
                    low = _minwise(s)
                    sets.append(_set_id(s.tobytes()))
                    tokens.append(low[:TREES].view(np.int64).tolist())
                    least = (_mixed(low[TREES:]) >> np.uint64(56)).astype(np.uint8).tobytes()
                    sketches.append(least[:SKETCH]), further.append(least[SKETCH:])
                else:
                    sets.append(None), tokens.append(None), sketches.append(None), further.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(further, pa.binary())],
                ["doc_id", "n_shingles", "set_id", "tokens", "sketch", "further"],
            )

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sign, "doc_id long, n_shingles long, set_id binary, tokens array<long>, sketch binary, further binary"
    )


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(set_id, s) of every text with words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            made = [m for m in (shingle_set(t.as_py(), width).tobytes() for t in x.column("text")) if m]
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(m) for m in made], pa.binary()), pa.array(made, pa.binary())], ["set_id", "s"])

    return texts.mapInArrow(make, "set_id binary, s binary")


class Joined:
    """Components of the rows of a task, and which pairs are left to compare."""

    def __init__(self, comps: np.ndarray, asks: np.ndarray) -> None:
        self.of = np.unique(comps, return_inverse=True)[1]
        self.asks, self.done = asks, np.zeros(len(comps), bool)

    def next(self) -> int | None:
        """A row to compare with all, from outside the largest component if there is one."""
        sizes = np.bincount(self.of)
        largest = int(sizes.argmax())
        if sizes[largest] == len(self.of):
            return None
        waiting = self.asks & ~self.done
        outside = np.flatnonzero(waiting & (self.of != largest))
        if len(outside):
            return int(outside[0])
        # What waits is in one component: only rows of others that were not compared with everything matter.
        inside = np.flatnonzero(waiting)
        return int(inside[0]) if len(inside) and (~self.done & (self.of != largest)).any() else None

    def met(self, i: int, alike: np.ndarray) -> np.ndarray:
        """Rows whose components join that of ``i``; one row for each."""
        self.done[i] = True
        rows = np.flatnonzero(alike & (self.of != self.of[i]))
        comps, first = np.unique(self.of[rows], return_index=True)
        self.of[np.isin(self.of, comps)] = self.of[i]
        return rows[first]


def _equal_bytes(sketches: np.ndarray, i: int) -> np.ndarray:
    """In how many of 128 bytes each sketch equals sketch ``i``."""
    lanes = (sketches == sketches[i]).view(np.uint64).sum(axis=1, dtype=np.uint64)
    return (lanes * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _fit(sizes: np.ndarray, i: int) -> np.ndarray:
    return 100 * np.minimum(sizes, sizes[i]) >= SIMILARITY * np.maximum(sizes, sizes[i])


def suspects(comps: np.ndarray, asks: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, first: bool) -> list[np.ndarray]:
    """Groups of rows, of several components, that sketches hold together; rows to compare meet each other in the first block only."""
    joined = Joined(np.arange(len(comps)), asks)
    others = first | ~asks
    while (i := joined.next()) is not None:
        joined.met(i, (_equal_bytes(sketches, i) >= LEAST_EQUAL) & _fit(sizes, i) & others & (comps != comps[i]))
    order = np.argsort(joined.of, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(joined.of[order])) + 1)
    return [g for g in groups if len(g) > 1 and asks[g].any()]


def exact_links(comps: np.ndarray, asks: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of rows that reach the similarity, enough to join their components: each asking row meets all others."""
    joined, links = Joined(comps, asks), []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(tokens), np.int32)
    while (i := joined.next()) is not None:
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        links += [(i, int(j)) for j in joined.met(i, 100 * common >= SIMILARITY * (sizes + sizes[i] - common))]
    return links


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of equal ``key``, which follow each other, across batches."""
    held: list[pa.RecordBatch] = []
    for x in batches:
        if not x.num_rows:
            continue
        keys = x.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            held.append(x.slice(a, b - a))
            if b < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _suspected(members: DataFrame) -> DataFrame:
    """(part, rep, set_id, comp, ask) of the suspects among members with their sketches."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "place"):
            if t.num_rows < 2:
                continue
            place, first = t.column("place")[0].as_py(), t.column("first")[0].as_py()
            t = t.combine_chunks()
            rep, comp, ask, size = (t.column(c).to_numpy() for c in ("rep", "comp", "ask", "n_shingles"))
            sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            for g in suspects(comp, ask, size, sketches, first):
                g = g[np.argsort(size[g], kind="stable")]
                piece = np.cumsum(size[g]) // PART
                pieces = [g[piece == p] for p in np.unique(piece)]
                for a in range(len(pieces)):
                    for b in range(a, len(pieces)):
                        both = pieces[a] if a == b else np.concatenate([pieces[a], pieces[b]])
                        if ask[both].any() and (comp[both] != comp[both[0]]).any():
                            name = hashlib.blake2b(repr((place, rep[g].min(), a, b)).encode(), digest_size=8).digest()
                            kept = t.select(["rep", "set_id", "comp", "ask"]).take(both).combine_chunks()
                            part = pa.array(np.full(len(both), int.from_bytes(name, "little", signed=True)))
                            yield pa.RecordBatch.from_arrays([part, *(c.combine_chunks() for c in kept.columns)], ["part", *kept.column_names])

    return members.mapInArrow(find, "part long, rep long, set_id binary, comp long, ask boolean")


def _linked(found: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Links (u, v) among suspects by their full sets."""
    ends = broadcast_if_small(found.select("rep").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ends, "rep", "left_semi").select("text")
    sets = _sets(texts, width).groupBy("set_id").agg(F.first("s").alias("s"))
    dealt = found.join(sets, "set_id").repartition("part").sortWithinPartitions("part")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "part"):
            rep, comp, ask = (t.column(c).to_numpy() for c in ("rep", "comp", "ask"))
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("s")]
            links = exact_links(comp, ask, sets)
            yield pa.RecordBatch.from_arrays([pa.array(rep[[x[k] for x in links]], pa.int64()) if links else pa.array([], pa.int64()) for k in (0, 1)], ["u", "v"])

    return dealt.select("part", "rep", "comp", "ask", "s").mapInArrow(check, "u long, v long")


def _nodes(rows: DataFrame) -> DataFrame:
    """Nodes with several components: members, the largest component (``base``), open members, pivots (one of it, others of any)."""
    inside = rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first"))
    one = F.struct(F.col("first").alias("pivot"), F.col("comp").alias("own"))
    others = [F.min(F.struct(F.xxhash64("node", "comp", F.lit(i)).alias("h"), one.alias("p"))) for i in range(PIVOTS)]
    nodes = inside.groupBy("node").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", one.alias("p"))).alias("most"), F.array(*others).alias("others")
    )
    pivots = F.array_distinct(F.concat(F.array("most.p"), F.transform("others", lambda x: x["p"])))
    return nodes.where(F.col("n") > F.col("most.n")).select("node", "n", F.col("most.p.own").alias("base"), (F.col("n") - F.col("most.n")).alias("n_open"), pivots.alias("pivots"))


def _branched(rows: DataFrame, level: int) -> DataFrame:
    """The rows once for each child of their node, which takes its place. ``least`` holds the minwise bytes to branch on."""
    made = rows.withColumn("child", F.explode(F.sequence(F.lit(1), F.lit(children(level))))) if children(level) > 1 else rows.withColumn("child", F.lit(1))
    at = F.pmod(F.xxhash64("node", "child", F.lit(level)), F.lit(SKETCH + FURTHER)).cast("int") + 1
    return made.withColumn("node", F.xxhash64("node", "child", F.lit(level), F.substring("least", at, F.lit(1)))).drop("child")


def _renamed(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """``rows`` with their components as known by now."""
    if known is None:
        return rows
    return rows.drop("comp").join(known.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _placed(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(place, first, rep, comp, ask): who meets in which task; and the rows of nodes with too many open members."""
    met = rows.join(_nodes(rows), "node").withColumn("settled", F.col("n_open") <= most)
    ask = F.when(F.col("settled"), F.col("comp") != F.col("base")).otherwise(F.exists("pivots", lambda p: p["pivot"] == F.col("rep")))
    blocks = F.ceil((F.col("n") - F.when(F.col("settled"), F.col("n_open")).otherwise(0)) / BLOCK).cast("int")
    met = packed(met.select("node", "rep", "comp", "settled", ask.alias("ask"), F.greatest(blocks, F.lit(1)).alias("blocks")))
    block = F.explode(F.when(F.col("ask"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))))
    spread = met.select("node", "rep", "comp", "ask", block.alias("block"))
    placed = spread.select(F.xxhash64("node", "block").alias("place"), (F.col("block") == 0).alias("first"), "rep", "comp", "ask")
    return placed, met.where(~F.col("settled")).select("node", "rep", "comp")


def _grown(rows: DataFrame, known: DataFrame | None, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame | None:
    """The known components joined by the links of all nodes (node, rep, comp) and, where they are large, of those below them."""
    level = 0
    while True:
        level += 1
        most = SMALL * level
        placed, large = _placed(rows, most)
        members = placed.join(classes.select("rep", "set_id", "n_shingles", "sketch"), "rep").repartition("place").sortWithinPartitions("place")
        links = _linked(packed(_suspected(members)), docs, width)
        if known is not None:
            links = links.unionAll(known.select(F.col("node").alias("u"), F.col("component").alias("v")))
        known = packed(components(packed(links)))
        if large.isEmpty():
            return known
        # Nodes whose families the pivots have joined may be settled now; the others branch.
        left = _renamed(large, known)
        left = packed(left.join(_nodes(left).select("node", "n_open"), "node"))
        wide = left.where(F.col("n_open") > most).join(classes.select("rep", F.concat("sketch", "further").alias("least")), "rep")
        below = _branched(wide, level).select("node", "rep", "comp")
        rows = packed(below.unionAll(left.where(F.col("n_open") <= most).select("node", "rep", "comp")))


def class_components(docs: DataFrame, classes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, component) of all representatives that have a link."""
    known = None
    for trees in (F.col("tree") == 0, F.col("tree") > 0):
        tokens = classes.select("rep", F.posexplode("tokens").alias("tree", "token")).where(trees)
        rows = _renamed(tokens.select(F.xxhash64("tree", "token").alias("node"), "rep", F.col("rep").alias("comp")), known)
        known = _grown(packed(rows), known, classes, docs, width)
    return known


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    docs = docs.select("doc_id", "text")
    signed = stored(signatures(docs, width), "signatures")
    filled = signed.where(F.col("doc_id").isNotNull() & F.col("set_id").isNotNull())
    classes = stored(
        filled.groupBy("set_id").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "tokens", "sketch", "further")]), "classes"
    )
    linked = class_components(docs, classes, width)
    named = classes.select("set_id", "rep").join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "set_id", F.coalesce("component", "rep").alias("found")
    )
    joined = signed.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that stay: of each component the one with the smallest id."""
    gone = near_duplicates(docs, width).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*docs.columns)
