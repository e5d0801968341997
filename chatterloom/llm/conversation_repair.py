"""Cheapest repair of conversations by integer weights.

Rows of a conversation, in turn order, are kept, given another role or deleted, and empty rows are inserted, so that the initials of the
roles read ``(s?(ua)+)?``. Every path through the automaton of that pattern is weighed by one integer: its high digits hold the cost, its low
digits, of fixed width and filled with zeros at the end, the letters of its edits. Putting an edit in front of a path adds its cost to
the high digits, shifts the low ones by one place and writes its letter first; both keep the order of two paths, so the smallest integer
is the cheapest path with the least letters, and one backward pass of integer minima over (row, state) decides everything.

A conversation may hold a third of all rows. Positions come from a range sort over all tasks. Blocks of ``BLOCK_ROWS`` positions become matrices: for each
pair of states the smallest path between them, and what the counts need at both ends. Two equal-cost paths between the same
states never have one's letters as a beginning of the other's (the rest would be inserts, which cost), so smallest parts make smallest
wholes. ``FAN`` neighbouring matrices are multiplied at a time, round by round, until one is left. Letters, never texts, meet in one row;
SHA-256 of a conversation is one sequential computation, which reads its sorted texts as a stream and holds one batch of them.

Nulls in any column count as one space, in ids for the damage only: null is a conversation of its own and null turns come first. Rows of equal turn
go by role and MD5 of the text; repeated rows are duplicates. Empty and blank texts are blank rows, texts may have any length. Roles
count by their first character, case matters; an empty role is none of the pattern. A conversation without rows after the damage has zeros; an empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.shared import small_batches
from chatterloom.operators.scale import cut_lineage, global_rank, join_null_safe

SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK_ROWS = 1000
FAN = 16
# Octal digits of the edits in the order of their letters; 0 fills the end.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
BITS = 3
TO_DIGITS, TO_LETTERS = str.maketrans("DIKR", "1234"), str.maketrans("1234", "DIKR")
# Automaton: before anything, after s, after u, after a.
STATES = 4
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)
# What a new or changed role must be in each state.
WANTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}

COUNTS = "blank long, duplicate long, truncated long, illegal long, distinct long, low long, high long, head string, tail string"
SUMMARY = f"conv_id long, block long, {COUNTS}, cells array<struct<cost:long,letters:string>>"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone) of the rows after the damage; ``gone`` marks dropped ones."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), as_text("role").alias("role"), as_text("text").alias("text"))
    kind = F.crc32(F.concat_ws(":", as_text("conv_id"), as_text("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies.alias("copy"))


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, initial, fault) in turn order; the fault is b, d, t or empty. ``rows`` are keyed."""
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    slim = rows.select("conv_id", "turn", "role", "key", "copy", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("open"))
    ranked = cut_lineage(global_rank(slim, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key"), F.col("copy")], ["conv_id"], "pos", 0))
    same = ranked.where("NOT blank").groupBy("conv_id", "role", "key").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    met = join_null_safe(ranked, same.where("n > 1").drop("n"), ["conv_id", "role", "key"], "left")
    fault = F.when(F.col("blank"), "b").when(F.col("pos") > F.col("first"), "d").when(F.col("open"), "t").otherwise("")
    return met.select("conv_id", "pos", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


class Weights:
    """Integer weights of paths with at most ``width`` edits."""

    def __init__(self, width: int) -> None:
        self.low = BITS * width
        self.mask = (1 << self.low) - 1

    def of(self, cost: int, letters: str) -> int:
        digits = int("0" + letters.translate(TO_DIGITS), 8) << (self.low - BITS * len(letters))
        return cost << self.low | digits

    def put_first(self, letter: str, cost: int, path: int) -> int:
        return (((path >> self.low) + cost) << self.low) | DIGIT[letter] << (self.low - BITS) | (path & self.mask) >> BITS

    def joined(self, first: tuple[int, str], then: int) -> int:
        """A part in front of a path."""
        cost, letters = first
        return self.of(cost, letters) + ((then >> self.low) << self.low) + ((then & self.mask) >> BITS * len(letters))

    def read(self, path: int) -> tuple[int, str]:
        digits = format(path & self.mask, "o").zfill(self.low // BITS) if self.low else ""
        return path >> self.low, digits.rstrip("0").translate(TO_LETTERS)


def smallest(*paths: int | None) -> int | None:
    return min((p for p in paths if p is not None), default=None)


def with_inserts(w: Weights, best: list[int | None]) -> list[int | None]:
    """Inserts in front: two rounds reach every state that inserts can lead to without a cycle."""
    for _ in range(2):
        after = [best[STEP[q, WANTED[q][0]]] for q in range(STATES)]
        best = [smallest(best[q], None if after[q] is None else w.put_first("I", INSERT, after[q])) for q in range(STATES)]
    return best


def before_row(w: Weights, best: list[int | None], initial: str, fault: str) -> list[int | None]:
    """Smallest paths from in front of a row, given those from behind it."""
    out = []
    for q in range(STATES):
        options = [None if best[q] is None else w.put_first("D", DELETE, best[q])]
        if fault not in ("b", "d"):
            more = TRUNCATED * (fault == "t")
            kept, changed = STEP.get((q, initial)), STEP[q, WANTED[q][0]]
            if kept is not None and best[kept] is not None:
                options.append(w.put_first("K", more, best[kept]))
            if best[changed] is not None:
                options.append(w.put_first("R", more + REROLE, best[changed]))
        out.append(smallest(*options))
    return with_inserts(w, out)


def matrix_of(rows: list[tuple[str, str]]) -> list[tuple[int, str] | None]:
    """Smallest (cost, letters) from state to state over the rows (initial, fault), row by row of the matrix."""
    # No smallest path inserts more than two rows in front of one.
    w = Weights(3 * len(rows) + 3)
    ends = []
    for target in range(STATES):
        best: list[int | None] = [w.of(0, "") if q == target else None for q in range(STATES)]
        for initial, fault in reversed(rows):
            best = before_row(w, best, initial, fault)
        ends.append([None if x is None else w.read(x) for x in best])
    return [ends[target][q] for q in range(STATES) for target in range(STATES)]


def product(first: list, then: list) -> list[tuple[int, str] | None]:
    w = Weights(max(len(x[1]) for x in first if x) + max(len(x[1]) for x in then if x))
    behind = [None if x is None else w.of(*x) for x in then]
    out = []
    for q in range(STATES):
        for target in range(STATES):
            parts = ((first[STATES * q + m], behind[STATES * m + target]) for m in range(STATES))
            best = smallest(*(w.joined(a, b) for a, b in parts if a is not None and b is not None))
            out.append(None if best is None else w.read(best))
    return out


def solved(cells: list) -> tuple[int, str]:
    """The smallest path from the start to an accepting state."""
    w = Weights(max(len(x[1]) for x in cells if x) + 3)
    end = with_inserts(w, [w.of(0, "") if q in ACCEPTING else None for q in range(STATES)])
    return w.read(smallest(*(w.joined(a, b) for a, b in zip(cells[:STATES], end) if a is not None and b is not None)))


def summary_of(rows: list[tuple[int | None, str, str]]) -> dict:
    """Counts and matrix of neighbouring rows (turn, initial, fault)."""
    turns = [t for t, _, _ in rows if t is not None]
    n = [sum(f == x for _, _, f in rows) for x in "bdt"]
    illegal = sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    ends = {"low": turns[0], "high": turns[-1]} if turns else {"low": None, "high": None}
    return {"blank": n[0], "duplicate": n[1], "truncated": n[2], "illegal": illegal, "distinct": len(set(turns)), **ends, "head": rows[0][1], "tail": rows[-1][1], "cells": matrix_of([r[1:] for r in rows])}


def merged(first: dict, then: dict) -> dict:
    """Summary of two neighbours."""
    out = {c: first[c] + then[c] for c in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    out["illegal"] += first["tail"] + then["head"] not in ("su", "ua", "au")
    out["distinct"] -= first["high"] is not None and first["high"] == then["low"]
    out["low"] = then["low"] if first["low"] is None else first["low"]
    out["high"] = first["high"] if then["high"] is None else then["high"]
    return out | {"head": first["head"], "tail": then["tail"], "cells": product(first["cells"], then["cells"])}


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with equal first ``keys`` columns, across batches."""
    rows = (row for x in batches for row in zip(*(c.to_pylist() for c in x.columns)))
    return groupby(rows, key=lambda r: r[:keys])


def _written(found: list[tuple[tuple, dict]], names: list[str]) -> pa.RecordBatch:
    kinds = {"head": pa.string(), "tail": pa.string()}
    cells = pa.array([[None if x is None else {"cost": x[0], "letters": x[1]} for x in s["cells"]] for _, s in found], pa.list_(pa.struct([("cost", pa.int64()), ("letters", pa.string())])))
    columns = [pa.array([k[0] for k, _ in found], pa.int64()), pa.array([k[1] for k, _ in found], pa.int64())]
    columns += [pa.array([s[c] for _, s in found], kinds.get(c, pa.int64())) for c in names[2:-1]]
    return pa.RecordBatch.from_arrays([*columns, cells], names)


def _summed(rows: DataFrame, of: Callable[[Iterator[tuple]], dict]) -> DataFrame:
    """One summary for each run of (conv_id, block); ``rows`` are sorted within partitions."""
    names = [c.split()[0] for c in SUMMARY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[tuple, dict]] = []
        for key, group in _groups(batches, 2):
            found.append((key, of(group)))
            if len(found) == 200:
                yield _written(found, names)
                found = []
        yield _written(found, names)

    return rows.mapInArrow(run, SUMMARY)


def _merged_run(group: Iterator[tuple]) -> dict:
    names, total = [c.split()[0] for c in COUNTS.split(", ")], None
    for row in group:
        one = dict(zip(names, row[3:])) | {"cells": [None if x is None else (x["cost"], x["letters"]) for x in row[-1]]}
        total = one if total is None else merged(total, one)
    return total


def summaries(marked: DataFrame) -> DataFrame:
    """One summary for each conversation."""
    blocked = marked.select("conv_id", F.floor(F.col("pos") / BLOCK_ROWS).alias("block"), "pos", "turn", "initial", "fault")
    dealt = blocked.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    out = cut_lineage(_summed(dealt, lambda group: summary_of([r[3:] for r in group])))
    while not out.where("block > 0").isEmpty():
        up = out.select("conv_id", F.floor(F.col("block") / FAN).alias("up"), "*").toDF("conv_id", "up", "_id", "block", *out.columns[2:]).drop("_id")
        dealt = up.repartition("conv_id", "up").sortWithinPartitions("conv_id", "up", "block")
        out = cut_lineage(_summed(dealt, _merged_run))
    return out


def _answers(found: DataFrame) -> DataFrame:
    """The columns of the result before the hash."""
    solve = F.udf(lambda cells: solved([None if x is None else (x["cost"], x["letters"]) for x in cells]), "cost long, audit string")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0))
    return found.withColumn("s", solve("cells")).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "s.cost", "s.audit")


def repaired_rows(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation."""
    q = 0
    for letter in audit:
        role, text = (WANTED[q], "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "R":
            role = WANTED[q]
        q = STEP[q, role[:1]]
        yield role, text


def _hashed(answers: DataFrame, rows: DataFrame) -> DataFrame:
    """The answers with the hash of the repaired texts, which follow their answer in order."""
    order = ["turn", "role", "key", "copy"]
    names = [c for c in answers.columns if c != "conv_id"]
    first = answers.select("conv_id", F.lit(0).alias("kind"), F.struct(*names).alias("answer"))
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "role", "text", "turn", "key", "copy")
    both = first.unionByName(texts, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *(F.col(c).asc_nulls_first() for c in order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv_id,), group in _groups(batches, 1):
            answer, digest, between = next(group)[2], hashlib.sha256(), b""
            for role, text in repaired_rows(answer["audit"], (r[3:5] for r in group)):
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            out.append({"conv_id": conv_id, **answer, "repaired_sha256": digest.hexdigest()})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    kinds = {"audit": pa.string(), "repaired_sha256": pa.string()}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.int64())) for c in RESULT.split(", ")])
    return small_batches(dealt).select("conv_id", "kind", "answer", "role", "text").mapInArrow(run, RESULT)


def repaired(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: gaps, faults, illegal neighbours, cost and letters of the repair, hash of what it leaves."""
    rows = damaged(conversations)
    there = keyed(rows.where(~F.col("gone")).drop("gone"))
    answers = _answers(summaries(faults(there)))
    empty = rows.where("gone").select(F.col("conv_id").alias("_id")).distinct().join(answers, F.col("_id").eqNullSafe(F.col("conv_id")), "left_anti")
    zeros = {c: F.lit("") if c == "audit" else F.lit(0).cast("long") for c in answers.columns if c != "conv_id"}
    return _hashed(answers.unionAll(empty.select(F.col("_id"), *[v.alias(c) for c, v in zeros.items()])), there)
