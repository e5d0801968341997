"""Connected components of a link table: each partition contracts its own links, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.operators.scale import cut_lineage


# Links of a partition that are contracted together.
LOCAL_LINKS = 200_000


def packed(df: DataFrame, rows: int = LOCAL_LINKS) -> DataFrame:
    """Checkpointed rows in no more partitions than their number needs."""
    df = cut_lineage(df)
    return df.coalesce(max(1, df.count() // rows + 1))


def _contracted(links: DataFrame) -> DataFrame:
    """Links (u, v) of the same components, v the smallest node that the partition knows of the component."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            path = []
            while (y := up.get(x, x)) != x:
                path.append(x)
                x = y
            for y in path:
                up[y] = x
            return x

        for batch in batches:
            for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        for i in range(0, len(nodes), 10_000):
            part = nodes[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([top(x) for x in part], pa.int64())], ["u", "v"])

    return links.select("u", "v").mapInArrow(contract, "u long, v long")


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link (u, v); the component is its smallest node.

    Ends when a round changes nothing, or where one partition held all links; hubs are joined, never collected. Links
    to itself and null ends are ignored.
    """
    edges = packed(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    whole, mark = edges.rdd.getNumPartitions() == 1, None
    edges = cut_lineage(_contracted(edges))
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if whole or now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = now
        edges = cut_lineage(_small(_large(edges)))
