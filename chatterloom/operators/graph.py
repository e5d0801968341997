"""Graph questions on edge tables ``src, dst[, weight]`` and vertex tables ``id``.

Iterative operators are loops of joins. Each round's table is checkpointed, which keeps plans
short and survives lost executors; a loop ends when nothing changes, there is no round limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.functions import fixed_values as V
from chatterloom.operators.scale import broadcast_if_small, cut_lineage, join_null_safe, kept_table

LEVELS_PER_FILE_SET = 8


# --- plain operators ------------------------------------------------------------------------------


def graph_size(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.agg(F.count("*").alias("n_vertices"), edges.agg(F.count("*")).scalar().alias("n_edges"))


def edge_between(edges: DataFrame, u: int, v: int) -> DataFrame:
    """The edge u -> v; no row if there is none."""
    return edges.where((F.col("src") == u) & (F.col("dst") == v))


def neighbours(edges: DataFrame, u: int) -> DataFrame:
    return edges.where(F.col("src") == u)


def reverse(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def insert_edges(edges: DataFrame, new: DataFrame, directed: bool = True, unique: bool = False) -> DataFrame:
    """Add edges, both ways if undirected; ``unique`` keeps one edge per pair of vertices."""
    added = new if directed else new.unionByName(reverse(new))
    merged = edges.unionByName(added)
    return without_duplicates(merged) if unique else merged


def remove_edges(edges: DataFrame, gone: DataFrame, directed: bool = True) -> DataFrame:
    pairs = gone.select("src", "dst")
    pairs = pairs if directed else pairs.unionByName(reverse(pairs))
    return edges.join(pairs.distinct(), ["src", "dst"], "left_anti")


def without_duplicates(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst), the lightest."""
    rest = [F.min(c).alias(c) for c in edges.columns if c not in ("src", "dst")]
    return edges.groupBy("src", "dst").agg(*rest) if rest else edges.distinct()


def edge_list(edges: DataFrame, directed: bool = True) -> DataFrame:
    return edges if directed else edges.where("src < dst")


def out_degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Out-degree per vertex, 0 without edges; edges are counted before they meet the vertices."""
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return vertices.join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def without_incoming(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


# --- breadth-first search ---------------------------------------------------------------------------


def _gather(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def bfs(edges: DataFrame, sources: DataFrame, target: int | None = None) -> DataFrame:
    """``id, level, parent`` of everything reachable from ``sources``; the parent is the smallest possible.

    Stops early once ``target`` is found.
    """
    links = cut_lineage(edges.select("src", "dst").distinct())
    frontier = cut_lineage(sources.select("id", F.lit(0).alias("level"), F.lit(None).cast("bigint").alias("parent")).dropDuplicates(["id"]))
    done = [frontier]
    level = 0
    while target is None or frontier.where(F.col("id") == target).isEmpty():
        level += 1
        reached = frontier.select(F.col("id").alias("src")).join(links, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        fresh = reached.join(_gather(done).select("id"), "id", "left_anti")
        frontier = cut_lineage(fresh.select("id", F.lit(level).alias("level"), "parent"))
        if frontier.isEmpty():
            break
        done.append(frontier)
        if len(done) > LEVELS_PER_FILE_SET:
            done = [cut_lineage(_gather(done))]
    return _gather(done)


def _single(edges: DataFrame, u: int) -> DataFrame:
    return edges.sparkSession.createDataFrame([(u,)], "id bigint")


def is_reachable(edges: DataFrame, u: int, v: int) -> DataFrame:
    """One row: does a path lead from u to v?"""
    found = bfs(edges, _single(edges, u), target=v).where(F.col("id") == v)
    return found.agg((F.count("*") > 0).alias("reachable"))


def bfs_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Search from every vertex in ascending order that no earlier search reached.

    Everything an earlier root reaches is closed under edges, so each tree lives inside one label
    of ``components`` and all trees grow at the same time.
    """
    labels = cut_lineage(components(vertices, edges))
    ends = labels.select(F.col("id").alias("dst"), F.col("component").alias("_to"))
    starts = labels.select(F.col("id").alias("src"), F.col("component").alias("_from"))
    inner = edges.select("src", "dst").join(starts, "src").join(ends, "dst").where("_from = _to").select("src", "dst")
    return bfs(inner, labels.where("id = component").select("id")).join(labels, "id")


def _walk_back(tree: DataFrame, v: int) -> DataFrame:
    """Path (array of ids) to v along ``parent`` links; no row if v is not in the tree.

    Ancestor doubling: round i knows the first 2^i ancestors of v and adds those 2^i links above them, from a table of
    everyone's 2^i-th ancestor that is joined with itself for the next round. A path of L links takes log L rounds.
    """
    jumps = cut_lineage(tree.where("parent IS NOT NULL").select(F.col("id").alias("_at"), F.col("parent").alias("_up")))
    path, reach = cut_lineage(tree.where(F.col("id") == v).select("id", F.lit(0).cast("bigint").alias("_back"))), 1
    while True:
        above = cut_lineage(path.join(jumps, F.col("id") == F.col("_at")).select(F.col("_up").alias("id"), (F.col("_back") + reach).alias("_back")))
        if above.isEmpty():
            break
        path, reach = path.unionAll(above), 2 * reach
        ahead = jumps.select(F.col("_at").alias("_mid"), F.col("_up").alias("_far"))
        jumps = cut_lineage(jumps.join(ahead, F.col("_up") == F.col("_mid")).select("_at", F.col("_far").alias("_up")))
    whole = path.agg(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("_order"), "id"))).alias("_ids"))
    return whole.where(F.size("_ids") > 0).select(F.transform("_ids", lambda x: x["id"]).alias("path"))


def bfs_path(edges: DataFrame, u: int, v: int) -> DataFrame:
    """A path u -> v with the fewest edges, as one array."""
    return _walk_back(bfs(edges, _single(edges, u), target=v), v)


# --- components ---------------------------------------------------------------------------------------


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest vertex from which ``id`` can be reached (itself included).

    Labels travel along edges and, since a label's own label reaches whatever the label reaches,
    also jump to it, so long chains need few rounds. Only changed labels are sent.
    """
    links = cut_lineage(edges.select("src", "dst").where("src != dst").distinct())
    labels = cut_lineage(vertices.select("id", F.col("id").alias("component"), F.lit(True).alias("_new")))
    while not labels.where("_new").isEmpty():
        sent = (
            labels.where("_new")
            .select(F.col("id").alias("src"), "component")
            .join(links, "src")
            .groupBy(F.col("dst").alias("id"))
            .agg(F.min("component").alias("_sent"))
        )
        heard = labels.join(sent, "id", "left").select(
            "id", F.least("component", F.coalesce("_sent", F.col("component"))).alias("_heard"), F.col("component").alias("_old")
        )
        jumps = labels.where("component != id").select(F.col("id").alias("_heard"), F.col("component").alias("_jump"))
        jumped = heard.join(jumps, "_heard", "left").select("id", F.coalesce("_jump", "_heard").alias("component"), "_old")
        labels = cut_lineage(jumped.select("id", "component", (F.col("component") < F.col("_old")).alias("_new")))
    return labels.select("id", "component")


def count_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return components(vertices, edges).agg(F.countDistinct("component").alias("n_components"))


# --- shortest paths -------------------------------------------------------------------------------------


def _lightest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.min(F.col("weight").cast("double")).alias("weight"))


def shortest_distances(edges: DataFrame, u: int) -> DataFrame:
    """``id, dist`` from u for positive weights. Only improved distances are relaxed further."""
    links = cut_lineage(_lightest(edges))
    known = cut_lineage(_single(edges, u).select("id", F.lit(0.0).alias("dist"), F.lit(True).alias("_new")))
    while not known.where("_new").isEmpty():
        offers = (
            known.where("_new")
            .select(F.col("id").alias("src"), "dist")
            .join(links, "src")
            .groupBy(F.col("dst").alias("id"))
            .agg(F.min(F.col("dist") + F.col("weight")).alias("_offer"))
        )
        better = F.col("_offer").isNotNull() & (F.col("dist").isNull() | (F.col("_offer") < F.col("dist")))
        known = cut_lineage(
            known.join(offers, "id", "full").select("id", F.when(better, F.col("_offer")).otherwise(F.col("dist")).alias("dist"), better.alias("_new"))
        )
    return known.select("id", "dist")


def tight_edges(edges: DataFrame, distances: DataFrame, tolerance: float = V.PATH_TOLERANCE) -> DataFrame:
    """Edges that lie on some shortest path: dist(src) + weight = dist(dst), and farther from the start.

    The second condition keeps weights below the tolerance, in both directions, from making a cycle.
    """
    start = distances.select(F.col("id").alias("src"), F.col("dist").alias("_a"))
    end = distances.select(F.col("id").alias("dst"), F.col("dist").alias("_b"))
    joined = _lightest(edges).join(start, "src").join(end, "dst")
    on_path = F.abs(F.col("_a") + F.col("weight") - F.col("_b")) < tolerance
    return joined.where(on_path & (F.col("_a") < F.col("_b"))).select("src", "dst", "weight")


def shortest_path_tree(edges: DataFrame, u: int) -> DataFrame:
    """``id, dist, parent``; the smallest of several possible parents."""
    distances = cut_lineage(shortest_distances(edges, u))
    parents = tight_edges(edges, distances).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    return distances.join(parents, "id", "left").select("id", "dist", F.when(F.col("id") != u, F.col("parent")).alias("parent"))


def shortest_path(edges: DataFrame, u: int, v: int) -> DataFrame:
    """One shortest path u -> v as an array of ids."""
    return _walk_back(cut_lineage(shortest_path_tree(edges, u)), v)


def _path_counts(tight: DataFrame, v: int) -> DataFrame:
    """``id, n``: number of paths to v over the path graph, for every vertex that has one."""
    weights = cut_lineage(_single(tight, v).select("id", F.lit(1).cast("bigint").alias("n")))
    found = [weights]
    while not weights.isEmpty():
        step = weights.join(tight, F.col("id") == F.col("dst"))
        weights = cut_lineage(step.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("n")))
        found.append(weights)
    return _gather(found).groupBy("id").agg(F.sum("n").alias("n"))


def shortest_path_page(edges: DataFrame, u: int, v: int, first: int = 0, size: int | None = None) -> DataFrame:
    """``nr, path``: the shortest paths u -> v number ``first`` and on, at most ``size``, in the order of their ids.

    Paths are counted, not listed: the paths that begin with an edge have neighbouring numbers, so a number alone tells which way to
    go from each vertex. The asked numbers are spread over all tasks and walk at the same time, one
    row for a number and step; a page of a huge listing costs no more than its own paths.
    """
    tight = cut_lineage(tight_edges(edges, cut_lineage(shortest_distances(edges, u))).select("src", "dst"))
    counts = cut_lineage(_path_counts(tight, v))
    mine = counts.where(F.col("id") == u).first()
    total = 0 if mine is None else mine["n"]
    before = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
    ways = tight.join(counts, F.col("dst") == F.col("id")).select("src", "dst", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_from"), "n")
    ways = broadcast_if_small(cut_lineage(ways.withColumn("_until", F.col("_from") + F.col("n")).drop("n")))
    last = total if size is None else min(total, first + size)
    numbers = edges.sparkSession.range(first, max(first, last)).withColumnRenamed("id", "nr")
    walkers = cut_lineage(numbers.select("nr", F.lit(u).cast("bigint").alias("at"), F.col("nr").alias("_rest"), F.lit(0).alias("step")))
    steps = [walkers]
    while not walkers.isEmpty():
        here = (F.col("at") == F.col("src")) & (F.col("_rest") >= F.col("_from")) & (F.col("_rest") < F.col("_until"))
        walkers = cut_lineage(walkers.join(ways, here).select("nr", F.col("dst").alias("at"), (F.col("_rest") - F.col("_from")).alias("_rest"), (F.col("step") + 1).alias("step")))
        steps.append(walkers)
    lists = _gather(steps).groupBy("nr").agg(F.array_sort(F.collect_list(F.struct("step", "at"))).alias("_s"))
    return lists.select("nr", F.transform("_s", lambda s: s["at"]).alias("path"))


def all_shortest_paths(edges: DataFrame, u: int, v: int) -> DataFrame:
    """Every shortest path u -> v as an array of ids."""
    return shortest_path_page(edges, u, v).select("path")


def count_shortest_paths(edges: DataFrame, u: int, v: int) -> DataFrame:
    """Number of shortest paths u -> v, summed over the path graph without listing paths."""
    tight = cut_lineage(tight_edges(edges, cut_lineage(shortest_distances(edges, u))).select("src", "dst"))
    return _path_counts(tight, v).where(F.col("id") == u).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_paths"))


def all_pairs_distances(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst, dist`` for all connected pairs, 0 from a vertex to itself.

    Distances double their reach every round. The result has up to V * V rows: for small graphs. A round joins what the last one found or
    improved with all pairs, on either side; pairs of a vertex with itself lengthen nothing and take no part. Each round keeps only its own finds:
    a pair that is improved later stays in its older table and loses to the smaller distance.
    """
    own = vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"))
    links = _lightest(edges.where("src IS NOT NULL")).withColumnRenamed("weight", "dist").select("src", "dst", "dist")
    fresh = kept_table(links.unionByName(own).groupBy("src", "dst").agg(F.min("dist").alias("dist")))
    found = [fresh]
    while not fresh.isEmpty():
        before = found[:-1]
        offers = _longer(fresh, _gather(found))
        if before:
            offers = offers.unionByName(_longer(_gather(before), fresh))
        # Offers and known distances meet in one grouping: a pair is fresh if its best offer beats what is known.
        known = _gather(found).select("src", "dst", F.col("dist").alias("_known"), F.lit(None).cast("double").alias("_offer"))
        offers = offers.select("src", "dst", F.lit(None).cast("double").alias("_known"), F.col("dist").alias("_offer"))
        best = known.unionByName(offers).groupBy("src", "dst").agg(F.min("_known").alias("_known"), F.min("_offer").alias("dist"))
        fresh = kept_table(best.where(F.col("dist").isNotNull() & (F.col("_known").isNull() | (F.col("dist") < F.col("_known")))).select("src", "dst", "dist"))
        found.append(fresh)
        if len(found) > LEVELS_PER_FILE_SET:
            # The last table stays apart, for the next round.
            found = [kept_table(_gather(found[:-1]).groupBy("src", "dst").agg(F.min("dist").alias("dist"))), fresh]
    pairs = _gather(found[:-1]).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    return _through_vertices(pairs, vertices, edges)


def _longer(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of ``left`` lengthened by pairs of ``right``."""
    ahead = right.where("NOT src <=> dst").select(F.col("src").alias("_mid"), F.col("dst").alias("_to"), F.col("dist").alias("_b"))
    back = left.where("NOT src <=> dst").select("src", F.col("dst").alias("_mid"), F.col("dist").alias("_a"))
    return back.join(ahead, "_mid").select("src", F.col("_to").alias("dst"), (F.col("_a") + F.col("_b")).alias("dist"))


def _through_vertices(pairs: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Without pairs of ends that are both no vertices, unless a vertex lies on a way between them. A null end is no vertex."""
    known = vertices.select("id").where("id IS NOT NULL").distinct()
    starts, ends = (edges.select(c).distinct().join(known, F.col(c) == F.col("id"), "left_anti").where(F.col(c).isNotNull()) for c in ("src", "dst"))
    starts = cut_lineage(starts)
    if starts.isEmpty():
        return pairs
    pairs = kept_table(pairs)
    ends = cut_lineage(ends.unionByName(starts.select(F.lit(None).cast("bigint").alias("dst")).limit(1)))
    stray = pairs.where("NOT src <=> dst").join(broadcast_if_small(starts), "src", "left_semi")
    stray = join_null_safe(stray, broadcast_if_small(ends), ["dst"], "left_semi")
    if stray.isEmpty():
        return pairs
    middle = known.select(F.col("id").alias("_mid"))
    heads = pairs.join(stray.select("src").distinct(), "src", "left_semi").select("src", F.col("dst").alias("_mid")).join(middle, "_mid")
    tails = pairs.join(stray.select("dst").distinct(), "dst", "left_semi").select(F.col("src").alias("_mid"), "dst")
    crossed = heads.join(tails, "_mid").select("src", "dst").distinct()
    lost = stray.join(crossed, ["src", "dst"], "left_anti").select("src", "dst")
    return join_null_safe(pairs, lost.withColumn("_lost", F.lit(True)), ["src", "dst"], "left").where("_lost IS NULL").drop("_lost")


# --- closure ----------------------------------------------------------------------------------------------


def transitive_closure(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Reflexive transitive closure ``src, dst``; each round extends only the pairs found last."""
    links = cut_lineage(edges.select("src", "dst").distinct())
    own = vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    fresh = kept_table(own)
    found = [fresh]
    while True:
        step = fresh.select("src", F.col("dst").alias("_mid")).join(links.select(F.col("src").alias("_mid"), "dst"), "_mid")
        fresh = kept_table(step.select("src", "dst").distinct().join(_gather(found), ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return _gather(found)
        found.append(fresh)
        if len(found) > LEVELS_PER_FILE_SET:
            found = [kept_table(_gather(found))]


def projectivity(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: is every vertex between the ends of an edge reachable from its source?

    All edges of a source together span one run of ids around it, so one count per source decides.
    """
    spans = edges.groupBy("src").agg(F.min("dst").alias("_lo"), F.max("dst").alias("_hi"))
    spans = spans.select("src", F.least("src", "_lo").alias("_lo"), F.greatest("src", "_hi").alias("_hi"))
    inside = transitive_closure(vertices, edges).join(spans, "src").where((F.col("dst") >= F.col("_lo")) & (F.col("dst") < F.col("_hi")))
    reached = inside.groupBy("src").agg(F.count("*").alias("_n"))
    gaps = spans.join(reached, "src", "left").where(F.coalesce("_n", F.lit(0)) < F.col("_hi") - F.col("_lo"))
    return gaps.agg((F.count("*") == 0).alias("projective"))
