"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. A source whose target is ``k`` times its size plus a rest is taken whole
``k`` times (certain copies); the rest is a sample without replacement of at most that many words, to which no
other document could be added. Documents are ranked by random odds ``u / (1 - u)`` divided by their inclusion odds; the
lowest ranks enter. Only the order matters for a sample of a set size, so inclusion odds may be given up to a factor per
source; here they grow with the logarithm of a document's size.

The cut is found by counting words per slice of the rank and refining the slice that holds it, so no source is
ever sorted or brought to one task. It stops at the first document that overshoots. Then the longest document that fits
is added, ``FILLS`` times, and after that the same cut is made again among the documents that fit the gap, until none does:
each round leaves a gap below the size of a document that fitted before. ``u`` comes from a hash of id and text: reruns agree.

Null texts have size 0 and take 0. Null sources form one source, last in order. Repeated rows (equal id and
text) share a rank and stand or fall together. Empty tables give empty results. ``mixed`` passes other columns on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.llm.shared import BLANKS, stored, words
from chatterloom.operators.scale import broadcast_if_small, cut_lineage

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_TIMES = 2.0
# Slices of the rank per round of refinement, and rounds: 2^40 slices in all.
SLICE_BITS, ROUNDS = 10, 4
# After the first cut, so many times the longest document that still fits is added; further cuts follow.
FILLS = 3
RANK_BITS = SLICE_BITS * ROUNDS
AGAIN = "array<struct<since:bigint,until:bigint,most:double>>"


def size_of(text: Column) -> Column:
    return F.size(words(text, BLANKS)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_TIMES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, so windows over all are small.

    Sources in code point order, null last, have the given weights in turn. Water filling in order of bound per
    weight: the first sources are at their bound; the first one below it sets the level for all that follow.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.lit(list(weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double")
    one = sizes.withColumn("weight", turn).withColumn("bound", most * F.col("source_size"))
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(), by_bound.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    placed = one.withColumn("level", level).withColumn("nr", F.row_number().over(by_bound))
    free = F.when(F.col("level") * F.col("weight") < F.col("bound"), F.struct("nr", "level"))
    target = F.when(F.col("nr") < F.coalesce("first.nr", F.lit(1 << 30)), F.col("bound")).otherwise(F.col("first.level") * F.col("weight"))
    return placed.withColumn("first", F.min(free).over(every)).select("source", "source_size", target.alias("target"))


def uniform(*parts: Column) -> Column:
    """In (0, 1), from 52 bits of an MD5."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def pareto_rank(u: Column, odds: Column) -> Column:
    """Random odds over inclusion odds, mapped in order to 0 .. 2^RANK_BITS - 1."""
    q = (u / (1 - u)) / odds
    return F.floor((q / (1 + q)) * F.lit(float((1 << RANK_BITS) - 1))).cast("long")


def ranked(docs: DataFrame) -> DataFrame:
    """The rows with ``size`` and ``rank`` beside their own columns."""
    sized = docs.withColumn("size", size_of(F.col("text")))
    return sized.withColumn("rank", pareto_rank(uniform(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))), F.log(F.col("size") + 3)))


def _beside(rows: DataFrame, per_source: DataFrame, *columns: str) -> DataFrame:
    """Rows with columns of their source, null for null. Few sources are broadcast after counting them."""
    other = broadcast_if_small(per_source.select(F.col("source").alias("_source"), *columns), 100_000)
    return rows.join(other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _cut(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Adds ``low`` (ranks below it enter) to the sources, whose rows hold more words than ``gap``; ``gap`` is what is then still wanted."""
    state = cut_lineage(state.withColumn("slice", F.lit(0).cast("long")))
    for done in range(ROUNDS):
        outer = RANK_BITS - SLICE_BITS * done
        inner = outer - SLICE_BITS
        inside = _beside(rows.select("source", "rank", "size"), state, "gap", "slice").where(F.shiftright("rank", outer) == F.col("slice"))
        counts = inside.groupBy("source", "gap", F.shiftright("rank", inner).alias("at")).agg(F.sum("size").alias("n"))
        running = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = counts.withColumn("upto", F.sum("n").over(running)).where(F.col("upto") > F.col("gap"))
        first = upto.groupBy("source").agg(F.min(F.struct("at", (F.col("upto") - F.col("n")).alias("before"))).alias("x"))
        first = first.select(F.col("source").alias("_source"), "x")
        met = state.join(first, F.col("source").eqNullSafe(F.col("_source")), "left")
        state = cut_lineage(met.withColumn("gap", F.col("gap") - F.coalesce("x.before", F.lit(0))).withColumn("slice", F.coalesce("x.at", F.lit(0))).select(*state.columns))
    return state.withColumnRenamed("slice", "low")


def _filled(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Adds ``fills``: ranks from ``low`` on that enter as well, each time the longest document that fits."""
    state = state.withColumn("fills", F.lit([]).cast("array<bigint>"))
    for _ in range(FILLS):
        fits = _beside(rows.select("source", "rank", "size"), state, "gap", "low", "fills").where(
            (F.col("rank") >= F.col("low")) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & ~F.array_contains("fills", F.col("rank"))
        )
        best = fits.groupBy("source").agg(F.max(F.struct("size", (-F.col("rank")).alias("minus"))).alias("x")).select(F.col("source").alias("_source"), "x")
        met = state.join(best, F.col("source").eqNullSafe(F.col("_source")), "left")
        fills = F.when(F.col("x").isNull(), F.col("fills")).otherwise(F.array_append("fills", -F.col("x.minus")))
        state = cut_lineage(met.withColumn("gap", F.col("gap") - F.coalesce("x.size", F.lit(0))).withColumn("fills", fills).select(*state.columns))
    return state


def _fitting(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows that have not entered and fit the gap of their source."""
    return _beside(rows.select("source", "rank", "size"), state, "gap", "next", "fills").where(
        (F.col("rank") >= F.col("next")) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & ~F.array_contains("fills", F.col("rank"))
    )


def _refilled(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Adds ``again``: of ranks from ``since`` to below ``until``, documents of up to ``most`` words (with their repeats) enter as well.

    What is longer than a gap is longer than all later ones, and a cut ends before a document that its own gap can't hold. So
    the next cut goes on from there, and the loop ends when no document fits.
    """
    state = state.withColumn("again", F.lit([]).cast(AGAIN)).withColumn("next", F.col("low"))
    while not _fitting(rows, state).isEmpty():
        # Repeated rows stand or fall together, so they are one document here.
        units = cut_lineage(_fitting(rows.groupBy("source", "rank").agg(F.sum("size").alias("size")), state).select("source", "rank", "size"))
        total = units.groupBy(F.col("source").alias("_source")).agg(F.sum("size").alias("total"))
        met = cut_lineage(state.join(total, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"))
        if met.where("total > 0").isEmpty():
            break
        ends = _cut(units, met.where(F.col("total") > F.col("gap")).select("source", "gap")).select(
            F.col("source").alias("_source"), F.col("gap").alias("left"), F.col("low").alias("end")
        )
        until = F.coalesce("end", F.lit(1 << RANK_BITS))
        added = F.struct(F.col("next").alias("since"), until.alias("until"), F.col("gap").cast("double").alias("most"))
        some = F.coalesce(F.col("total"), F.lit(0)) > 0
        state = cut_lineage(
            met.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left")
            .withColumn("again", F.when(some, F.array_append("again", added)).otherwise(F.col("again")))
            .withColumn("gap", F.when(some, F.coalesce("left", F.col("gap") - F.col("total"))).otherwise(F.col("gap")))
            .withColumn("next", F.when(some, until).otherwise(F.col("next")))
            .select(*state.columns)
        )
    return state.drop("next")


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_TIMES, further: bool = True) -> DataFrame:
    """Per source: source_size, target, whole copies, ``low``, ``fills`` and ``again``; ``rows`` as ``ranked`` gives them."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = targets(sizes, weights, share, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(F.lit(0)).cast("long")
    state = aimed.withColumn("whole", times).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    state = _filled(rows, _cut(rows, state.withColumn("gap", F.col("rest"))))
    return _refilled(rows, state) if further else state.withColumn("again", F.lit([]).cast(AGAIN))


def mixed(rows: DataFrame, planned: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``ranked`` rows with source_size, target, copies and taken words; ``known`` holds the same ranks in a cheaper table."""
    met = _beside(rows, planned, "source_size", "target", "whole", "low", "fills", "again").withColumn("_unit", F.col("size"))
    if not planned.where(F.size("again") > 0).isEmpty():
        units = (rows if known is None else known).groupBy(F.col("source").alias("_source"), F.col("rank").alias("_rank")).agg(
            F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_n")
        )
        repeated = broadcast_if_small(units.where("_n > 1").drop("_n"), 100_000)
        same = (F.col("rank") == F.col("_rank")) & F.col("source").eqNullSafe(F.col("_source"))
        met = met.join(repeated, same, "left").withColumn("_unit", F.coalesce("_size", "size")).drop("_source", "_rank", "_size")
    later = F.exists("again", lambda x: (F.col("rank") >= x["since"]) & (F.col("rank") < x["until"]) & (F.col("_unit") <= x["most"]))
    extra = (F.col("rank") < F.col("low")) | F.array_contains("fills", F.col("rank")) | (later & (F.col("size") > 0))
    copies = F.col("whole") + F.when(extra, 1).otherwise(0)
    return met.withColumn("copies", copies).withColumn("taken", F.col("size") * copies).drop("whole", "low", "fills", "again", "_unit")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_TIMES, further: bool = True) -> DataFrame:
    """(doc_id, source, size, rank, source_size, target, copies, taken) of every document row; without ``further`` only the first cut and its fills."""
    rows = stored(ranked(docs.select("doc_id", "text", "source")).drop("text"), "mixing")
    return mixed(rows, plan(rows, weights, share, most, further))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_TIMES) -> DataFrame:
    """The document rows that the mix takes, with all their columns and mix_size, mix_target, mix_copies and mix_taken.

    A column of ``docs`` with such a name gives way. A document without words is taken as often as its rank says, for it costs
    nothing.
    """
    rows = stored(ranked(docs.select("doc_id", "text", "source")).drop("text"), "mixing")
    planned = plan(rows, weights, share, most)
    added = {"mix_size": "size", "mix_target": "target", "mix_copies": "copies", "mix_taken": "taken"}
    names = [c for c in docs.columns if c not in ("doc_id", "text", "source", *added)]
    packed = docs.select("doc_id", "text", "source", F.struct(F.lit(0).alias("_"), *names).alias("_rest"))
    met = mixed(ranked(packed), planned, rows).where(F.col("copies") > 0)
    own = [F.col(f"_rest.{c}").alias(c) if c in names else F.col(c) for c in docs.columns if c not in added]
    return met.select(*own, *[F.col(c).alias(n) for n, c in added.items()])
