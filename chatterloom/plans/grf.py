"""Graph queries: the order hierarchy as a weighted graph, and trade between nations as a multigraph.

Hierarchy: region -> nation -> customer -> order -> supplier; ids are key * 8 + kind. All rows of
all tables take part. Iterative answers over pairs are checked with recursive SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.operators import graph as G
from chatterloom.plans.registry import query, table

REGION, NATION, CUSTOMER, ORDER, SUPPLIER = range(5)
START = 1 * 8 + REGION
GOAL = 5 * 8 + SUPPLIER


def _id(column: str, kind: int) -> F.Column:
    return F.col(column).cast("bigint") * 8 + kind


def vertices(spark: SparkSession, d: str) -> DataFrame:
    kinds = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("orders", "o_orderkey"), ("supplier", "s_suppkey")]
    tables = [table(spark, d, name).select(_id(key, kind).alias("id")) for kind, (name, key) in enumerate(kinds)]
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return out


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    def links(name: str, src: str, src_kind: int, dst: str, dst_kind: int) -> DataFrame:
        return table(spark, d, name).select(_id(src, src_kind).alias("src"), _id(dst, dst_kind).alias("dst"))

    edges = (
        links("nation", "n_regionkey", REGION, "n_nationkey", NATION)
        .union(links("customer", "c_nationkey", NATION, "c_custkey", CUSTOMER))
        .union(links("orders", "o_custkey", CUSTOMER, "o_orderkey", ORDER))
        .union(links("lineitem", "l_orderkey", ORDER, "l_suppkey", SUPPLIER).distinct())
    )
    return edges.withColumn("weight", ((F.col("src") + F.col("dst")) % 7 + 1).cast("double"))


def trade(spark: SparkSession, d: str) -> DataFrame:
    """One edge per line item, from the customer's to the supplier's nation."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    joined = items.join(orders, "l_orderkey").join(customers, "o_custkey").join(suppliers, "l_suppkey")
    return joined.select(F.col("c_nationkey").cast("bigint").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst"))


def nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))


VERTICES = """vertices AS (SELECT r_regionkey::BIGINT * 8 AS id FROM region UNION ALL SELECT n_nationkey::BIGINT * 8 + 1 FROM nation
  UNION ALL SELECT c_custkey * 8 + 2 FROM customer UNION ALL SELECT o_orderkey * 8 + 3 FROM orders UNION ALL SELECT s_suppkey * 8 + 4 FROM supplier)"""
EDGES = """edges AS (SELECT src, dst, ((src + dst) % 7 + 1)::DOUBLE AS weight FROM (
  SELECT n_regionkey::BIGINT * 8 AS src, n_nationkey::BIGINT * 8 + 1 AS dst FROM nation
  UNION ALL SELECT c_nationkey::BIGINT * 8 + 1, c_custkey * 8 + 2 FROM customer
  UNION ALL SELECT o_custkey * 8 + 2, o_orderkey * 8 + 3 FROM orders
  UNION ALL SELECT DISTINCT l_orderkey * 8 + 3, l_suppkey * 8 + 4 FROM lineitem))"""
TRADE = """trade AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"""
REACH = """reach AS (SELECT id AS src, id AS dst FROM vertices
  UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)"""
COMPONENTS = "components AS (SELECT dst AS id, min(src) AS component FROM reach GROUP BY dst)"
LEVELS = f"""steps AS (SELECT {START}::BIGINT AS id, 0 AS level UNION SELECT e.dst, s.level + 1 FROM steps s JOIN edges e ON s.id = e.src),
levels AS (SELECT id, min(level) AS level FROM steps GROUP BY id),
tree AS (SELECT l.id, l.level, min(p.id) AS parent FROM levels l LEFT JOIN edges e ON e.dst = l.id
  LEFT JOIN levels p ON p.id = e.src AND p.level + 1 = l.level GROUP BY l.id, l.level)"""
DISTANCES = f"""walks AS (SELECT {START}::BIGINT AS id, 0::DOUBLE AS dist UNION SELECT e.dst, w.dist + e.weight FROM walks w JOIN edges e ON w.id = e.src),
distances AS (SELECT id, min(dist) AS dist FROM walks GROUP BY id),
tight AS (SELECT e.src, e.dst FROM edges e JOIN distances a ON a.id = e.src JOIN distances b ON b.id = e.dst WHERE a.dist + e.weight = b.dist),
tree AS (SELECT d.id, d.dist, min(t.src) AS parent FROM distances d LEFT JOIN tight t ON t.dst = d.id GROUP BY d.id, d.dist)"""
BACKWARDS = f"""back AS (SELECT {GOAL}::BIGINT AS id, '{GOAL}' AS path UNION ALL SELECT t.src, t.src || '>' || b.path FROM back b JOIN tight t ON t.dst = b.id)"""
WALK = f"""walk AS (SELECT id, parent, id::VARCHAR AS path FROM tree WHERE id = {GOAL}
  UNION ALL SELECT t.id, t.parent, t.id || '>' || w.path FROM walk w JOIN tree t ON t.id = w.parent)"""


def path_text(df: DataFrame, *others: str) -> DataFrame:
    return df.select(*others, F.array_join(F.transform("path", lambda p: p.cast("string")), ">").alias("path"))


@query("grf_01_size", f"WITH {VERTICES}, {EDGES} SELECT (SELECT count(*) FROM vertices) AS n_vertices, (SELECT count(*) FROM edges) AS n_edges")
def grf_01(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_size(vertices(spark, d), hierarchy(spark, d))


@query("grf_02_neighbours", f"WITH {EDGES} SELECT src, dst, weight FROM edges WHERE src = 25")
def grf_02(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbours(hierarchy(spark, d), 3 * 8 + NATION)


@query("grf_02_edge_lookup", f"WITH {EDGES} SELECT src, dst, weight FROM edges WHERE src = 8 AND dst = 9")
def grf_02_edge(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_between(hierarchy(spark, d), START, 1 * 8 + NATION)


@query(
    "grf_03_insert_remove",
    f"""WITH {EDGES}, {TRADE}, new AS (SELECT src, dst FROM trade UNION SELECT dst, src FROM trade),
    merged AS (SELECT src, dst FROM edges UNION SELECT src, dst FROM new)
    SELECT src, dst FROM merged m WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE m.src = n.n_nationkey AND m.dst = n.n_regionkey)""",
)
def grf_03(spark: SparkSession, d: str) -> DataFrame:
    merged = G.insert_edges(hierarchy(spark, d).select("src", "dst"), trade(spark, d).distinct(), directed=False, unique=True)
    gone = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"), F.col("n_regionkey").cast("bigint").alias("dst"))
    return G.remove_edges(merged, gone)


@query("grf_04_edge_list", f"WITH {TRADE} SELECT DISTINCT src, dst FROM trade WHERE src < dst")
def grf_04(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_list(G.without_duplicates(trade(spark, d)), directed=False)


@query(
    "grf_05_out_degree",
    f"""WITH {VERTICES}, {EDGES} SELECT v.id, count(e.src) AS degree FROM vertices v LEFT JOIN edges e ON e.src = v.id GROUP BY v.id""",
)
def grf_05(spark: SparkSession, d: str) -> DataFrame:
    return G.out_degree(vertices(spark, d), hierarchy(spark, d))


@query("grf_06_without_incoming", f"WITH {VERTICES}, {EDGES} SELECT id FROM vertices WHERE id NOT IN (SELECT dst FROM edges)")
def grf_06(spark: SparkSession, d: str) -> DataFrame:
    return G.without_incoming(vertices(spark, d), hierarchy(spark, d))


@query("grf_07_reachable", f"WITH RECURSIVE {EDGES}, {LEVELS} SELECT count(*) > 0 AS reachable FROM levels WHERE id = {GOAL}")
def grf_07(spark: SparkSession, d: str) -> DataFrame:
    return G.is_reachable(hierarchy(spark, d), START, GOAL)


@query("grf_08_components", f"WITH RECURSIVE {VERTICES}, {EDGES}, {REACH}, {COMPONENTS} SELECT id, component FROM components")
def grf_08(spark: SparkSession, d: str) -> DataFrame:
    return G.components(vertices(spark, d), hierarchy(spark, d))


@query(
    "grf_08_component_count",
    f"WITH RECURSIVE {VERTICES}, {EDGES}, {REACH}, {COMPONENTS} SELECT count(DISTINCT component) AS n_components FROM components",
)
def grf_08_count(spark: SparkSession, d: str) -> DataFrame:
    return G.count_components(vertices(spark, d), hierarchy(spark, d))


@query("grf_09_bfs", f"WITH RECURSIVE {EDGES}, {LEVELS} SELECT id, level, parent FROM tree")
def grf_09(spark: SparkSession, d: str) -> DataFrame:
    return G.bfs(hierarchy(spark, d), spark.createDataFrame([(START,)], "id bigint"))


@query(
    "grf_09_bfs_forest",
    f"""WITH RECURSIVE {VERTICES}, {EDGES}, {REACH}, {COMPONENTS},
    inside AS (SELECT e.src, e.dst FROM edges e JOIN components a ON a.id = e.src JOIN components b ON b.id = e.dst
      WHERE a.component = b.component),
    steps AS (SELECT id, component, 0 AS level FROM components WHERE id = component
      UNION SELECT i.dst, s.component, s.level + 1 FROM steps s JOIN inside i ON s.id = i.src),
    levels AS (SELECT id, component, min(level) AS level FROM steps GROUP BY id, component)
    SELECT l.id, l.component, l.level, min(p.id) AS parent FROM levels l LEFT JOIN inside i ON i.dst = l.id
      LEFT JOIN levels p ON p.id = i.src AND p.level + 1 = l.level GROUP BY l.id, l.component, l.level""",
)
def grf_09_forest(spark: SparkSession, d: str) -> DataFrame:
    return G.bfs_forest(vertices(spark, d), hierarchy(spark, d))


@query("grf_10_bfs_path", f"WITH RECURSIVE {EDGES}, {LEVELS}, {WALK} SELECT path FROM walk WHERE parent IS NULL")
def grf_10(spark: SparkSession, d: str) -> DataFrame:
    return path_text(G.bfs_path(hierarchy(spark, d), START, GOAL))


@query("grf_11_shortest_tree", f"WITH RECURSIVE {EDGES}, {DISTANCES} SELECT id, dist, parent FROM tree")
def grf_11(spark: SparkSession, d: str) -> DataFrame:
    return G.shortest_path_tree(hierarchy(spark, d), START)


@query("grf_12_shortest_path", f"WITH RECURSIVE {EDGES}, {DISTANCES}, {WALK} SELECT path FROM walk WHERE parent IS NULL")
def grf_12(spark: SparkSession, d: str) -> DataFrame:
    return path_text(G.shortest_path(hierarchy(spark, d), START, GOAL))


@query("grf_13_all_shortest_paths", f"WITH RECURSIVE {EDGES}, {DISTANCES}, {BACKWARDS} SELECT path FROM back WHERE id = {START}")
def grf_13(spark: SparkSession, d: str) -> DataFrame:
    return path_text(G.all_shortest_paths(hierarchy(spark, d), START, GOAL))


@query(
    "grf_13_path_page",
    f"""WITH RECURSIVE {EDGES}, {DISTANCES}, {BACKWARDS} SELECT nr, path FROM (
      SELECT row_number() OVER (ORDER BY list_transform(string_split(path, '>'), lambda x: x::BIGINT)) - 1 AS nr, path FROM back WHERE id = {START})
    WHERE nr BETWEEN 1 AND 3""",
)
def grf_13_page(spark: SparkSession, d: str) -> DataFrame:
    page = G.shortest_path_page(hierarchy(spark, d), START, GOAL, first=1, size=3)
    return path_text(page, "nr")


@query("grf_13_path_count", f"WITH RECURSIVE {EDGES}, {DISTANCES}, {BACKWARDS} SELECT count(*) AS n_paths FROM back WHERE id = {START}")
def grf_13_count(spark: SparkSession, d: str) -> DataFrame:
    return G.count_shortest_paths(hierarchy(spark, d), START, GOAL)


@query(
    "grf_14_all_pairs",
    f"""WITH RECURSIVE {VERTICES}, {EDGES}, walks AS (SELECT id AS src, id AS dst, 0::DOUBLE AS dist FROM vertices
      UNION SELECT w.src, e.dst, w.dist + e.weight FROM walks w JOIN edges e ON w.dst = e.src)
    SELECT src, dst, min(dist) AS dist FROM walks GROUP BY src, dst""",
)
def grf_14(spark: SparkSession, d: str) -> DataFrame:
    return G.all_pairs_distances(vertices(spark, d), hierarchy(spark, d))


@query("grf_15_closure", f"WITH RECURSIVE {VERTICES}, {EDGES}, {REACH} SELECT src, dst FROM reach")
def grf_15(spark: SparkSession, d: str) -> DataFrame:
    return G.transitive_closure(vertices(spark, d), hierarchy(spark, d))


@query(
    "grf_16_projectivity",
    f"""WITH RECURSIVE {TRADE}, edges AS (SELECT DISTINCT src, dst FROM trade),
    reach AS (SELECT n_nationkey::BIGINT AS src, n_nationkey::BIGINT AS dst FROM nation
      UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)
    SELECT count(*) = 0 AS projective FROM (SELECT src, unnest(range(least(src, dst), greatest(src, dst))) AS k FROM edges) g
    WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.src = g.src AND r.dst = g.k)""",
)
def grf_16(spark: SparkSession, d: str) -> DataFrame:
    return G.projectivity(nations(spark, d), G.without_duplicates(trade(spark, d)))


@query("grf_17_copy", f"WITH {TRADE} SELECT DISTINCT src, dst FROM trade")
def grf_17(spark: SparkSession, d: str) -> DataFrame:
    return G.without_duplicates(trade(spark, d))
