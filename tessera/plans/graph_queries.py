"""Graph queries over the supplier graph: suppliers of consecutive lines of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators.ranks import ranked
from tessera.plans.catalogue import query
from tessera.session import table

# The same graph in SQL: e(src, dst, weight), v(id, weight), and the degrees d.
EDGES = """
steps AS (SELECT lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS src, l_suppkey AS dst FROM lineitem),
e AS MATERIALIZED (SELECT src, dst, count(*) AS weight FROM steps WHERE src IS NOT NULL AND src <> dst GROUP BY 1, 2),
v AS MATERIALIZED (SELECT s_suppkey AS id, 1 + s_nationkey % 5 AS weight FROM supplier)
"""
DEGREES = """,
d AS (SELECT id, (SELECT count(*) FROM e WHERE src = id) AS out_degree, (SELECT count(*) FROM e WHERE dst = id) AS in_degree FROM v)
"""
WITH = "WITH " + EDGES
WITH_DEGREES = WITH + DEGREES
WITH_RECURSIVE = "WITH RECURSIVE " + EDGES


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5 + 1).alias("weight"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.supplier_graph(table(spark, sf_dir, "lineitem"))


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where("src < dst")


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("community"))


@query("supplier_edges", WITH + "SELECT * FROM e")
def supplier_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query("edges_transpose", WITH + "SELECT dst AS src, src AS dst, weight FROM e")
def edges_transpose(spark, sf_dir):
    return G.transpose(edges(spark, sf_dir))


@query("edges_self_loops", WITH + "SELECT src, dst FROM e UNION ALL SELECT id, id FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = id AND dst = id)")
def edges_self_loops(spark, sf_dir):
    return G.self_loops_added(suppliers(spark, sf_dir), edges(spark, sf_dir))


@query(
    "edges_undirected",
    WITH + "SELECT src, dst FROM e WHERE src < dst UNION ALL SELECT DISTINCT dst, src FROM e a WHERE src < dst",
)
def edges_undirected(spark, sf_dir):
    return G.undirected(dag(spark, sf_dir))


@query("adjacency_lists", WITH + "SELECT src, count(*) AS n_neighbours, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM e GROUP BY src")
def adjacency_lists(spark, sf_dir):
    listed = G.adjacency(edges(spark, sf_dir))
    return listed.select("src", F.size("neighbours").cast("long").alias("n_neighbours"), F.concat_ws(",", F.col("neighbours").cast("array<string>")).alias("neighbours"))


@query("csr_row_pointers", WITH_DEGREES + "SELECT id, CAST(sum(out_degree) OVER (ORDER BY id) - out_degree AS BIGINT) AS start, CAST(sum(out_degree) OVER (ORDER BY id) AS BIGINT) AS stop FROM d")
def csr_row_pointers(spark, sf_dir):
    return G.csr_row_pointers(suppliers(spark, sf_dir), edges(spark, sf_dir))


@query("csr_to_coo", WITH + "SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS slot FROM e")
def csr_to_coo(spark, sf_dir):
    listed = G.adjacency(edges(spark, sf_dir))
    return listed.select("src", F.posexplode("neighbours").alias("slot", "dst")).select("src", "dst", F.col("slot").cast("long").alias("slot"))


@query("degree_in_out", WITH_DEGREES + "SELECT * FROM d")
def degree_in_out(spark, sf_dir):
    return G.degrees(suppliers(spark, sf_dir), edges(spark, sf_dir))


@query(
    "graph_metrics",
    WITH_DEGREES
    + """SELECT count(*) AS num_nodes, CAST(sum(out_degree) AS BIGINT) AS num_edges, sum(out_degree) / (count(*) * (count(*) - 1)) AS density,
    avg(out_degree) AS avg_degree, max(out_degree) AS max_degree, min(out_degree) AS min_degree, CAST(median(out_degree) AS DOUBLE) AS median_degree,
    var_pop(out_degree) AS degree_variance, count(*) FILTER (out_degree = 0) AS no_out_edges, count(*) FILTER (out_degree = 0 AND in_degree = 0) AS isolated,
    count(*) FILTER (in_degree = 0 AND out_degree > 0) AS sources, count(*) FILTER (out_degree = 0 AND in_degree > 0) AS sinks FROM d""",
)
def graph_metrics(spark, sf_dir):
    return G.graph_metrics(suppliers(spark, sf_dir), edges(spark, sf_dir))


@query(
    "degree_histogram",
    WITH_DEGREES
    + """SELECT b AS bin, CAST(floor(b * w) AS BIGINT) AS lower_edge, (SELECT count(*) FROM d WHERE least(floor(out_degree / w), 9) = b) AS num_nodes
    FROM range(0, 10) t(b), (SELECT (max(out_degree) + 1) / 10.0::DOUBLE AS w FROM d)""",
)
def degree_histogram(spark, sf_dir):
    return G.degree_histogram(suppliers(spark, sf_dir), edges(spark, sf_dir))


@query(
    "power_law_exponent",
    WITH_DEGREES + "SELECT round(1 + count(*) / (sum(ln(out_degree)) - count(*) * ln(min(out_degree))), 6) AS exponent FROM d WHERE out_degree > 0",
)
def power_law_exponent(spark, sf_dir):
    return G.power_law_exponent(suppliers(spark, sf_dir), edges(spark, sf_dir)).select(F.round("exponent", 6).alias("exponent"))


@query("hubs", WITH_DEGREES + "SELECT id, out_degree FROM d WHERE out_degree > (SELECT avg(out_degree) + stddev_pop(out_degree) FROM d)")
def hubs(spark, sf_dir):
    return G.find_hubs(suppliers(spark, sf_dir), edges(spark, sf_dir), 1.0)


@query("peripheral", WITH_DEGREES + "SELECT id, out_degree FROM d WHERE out_degree <= 90")
def peripheral(spark, sf_dir):
    return G.find_peripheral(suppliers(spark, sf_dir), edges(spark, sf_dir), 90)


@query(
    "degree_anomalies",
    WITH_DEGREES
    + """, z AS (SELECT id, out_degree, in_degree, (out_degree - avg(out_degree) OVER ()) / nullif(stddev_pop(out_degree) OVER (), 0) AS oz,
    (in_degree - avg(in_degree) OVER ()) / nullif(stddev_pop(in_degree) OVER (), 0) AS iz FROM d)
    SELECT id, out_degree, in_degree, round(coalesce(oz, 0), 6) AS out_z, round(coalesce(iz, 0), 6) AS in_z,
    CASE WHEN out_degree = 0 AND in_degree = 0 THEN 'isolated' WHEN oz > 2 AND iz > 2 THEN 'hub' WHEN oz > 2 THEN 'high_out_degree' WHEN oz < -2 THEN 'low_out_degree'
    WHEN iz > 2 THEN 'high_in_degree' WHEN iz < -2 THEN 'low_in_degree' ELSE 'none' END AS anomaly FROM z""",
)
def degree_anomalies(spark, sf_dir):
    found = G.degree_anomalies(suppliers(spark, sf_dir), edges(spark, sf_dir))
    return found.withColumn("out_z", F.round("out_z", 6)).withColumn("in_z", F.round("in_z", 6))


@query(
    "local_clustering",
    WITH_DEGREES
    + """SELECT id, CASE WHEN out_degree > 1 THEN round(floor((SELECT count(*) FROM e a JOIN e b ON a.src = b.src JOIN e c ON c.src = a.dst AND c.dst = b.dst
    WHERE a.src = d.id AND a.dst <> b.dst) / 2) * 2.0::DOUBLE / (out_degree * (out_degree - 1)), 6) ELSE 0 END AS coefficient FROM d""",
)
def local_clustering(spark, sf_dir):
    return G.local_clustering(suppliers(spark, sf_dir), edges(spark, sf_dir)).select("id", F.round("coefficient", 6).alias("coefficient"))


@query(
    "global_clustering",
    WITH
    + """, t AS (SELECT count(*) AS triangles FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND b.src < b.dst),
    p AS (SELECT CAST(sum(k * (k - 1) / 2) AS BIGINT) AS triplets FROM (SELECT count(*) AS k FROM e GROUP BY src))
    SELECT triangles, triplets, round(triangles / triplets, 6) AS coefficient FROM t, p""",
)
def global_clustering(spark, sf_dir):
    return G.global_clustering(suppliers(spark, sf_dir), edges(spark, sf_dir)).withColumn("coefficient", F.round("coefficient", 6))


def _pagerank_sql(rounds: int, jump: str) -> str:
    parts = [f"r0 AS MATERIALIZED (SELECT id, {jump} AS j, (SELECT count(*) FROM e WHERE src = id) AS o, {jump} AS s FROM v)"]
    for i in range(1, rounds + 1):
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT p.id, p.j, p.o, 0.15 * p.j + 0.85 * (coalesce(q.m, 0) + p.j * (SELECT coalesce(sum(s), 0) FROM r{i - 1} WHERE o = 0)) AS s"
            f" FROM r{i - 1} p LEFT JOIN (SELECT e.dst, sum(x.s / x.o) AS m FROM e JOIN r{i - 1} x ON x.id = e.src GROUP BY 1) q ON q.dst = p.id)"
        )
    return WITH + ", " + ", ".join(parts)


UNIFORM = "1.0::DOUBLE / (SELECT count(*) FROM v)"
SEEDED = "CASE WHEN id IN (1, 2, 3) THEN 1.0::DOUBLE / 3 ELSE 0 END"


@query("pagerank", _pagerank_sql(5, UNIFORM) + " SELECT id, round(s, 9) AS score FROM r5")
def pagerank(spark, sf_dir):
    ranked = G.pagerank(suppliers(spark, sf_dir), edges(spark, sf_dir), iterations=5, tolerance=0.0)
    return ranked.select("id", F.round("score", 9).alias("score"))


@query("pagerank_top_k", _pagerank_sql(5, UNIFORM) + " SELECT id, round(s, 9) AS score FROM r5 ORDER BY round(s, 9) DESC, id LIMIT 10")
def pagerank_top_k(spark, sf_dir):
    return G.top_k(pagerank(spark, sf_dir), 10)


@query("personalized_pagerank", _pagerank_sql(5, SEEDED) + " SELECT id, round(s, 9) AS score FROM r5")
def personalized_pagerank(spark, sf_dir):
    seeds = suppliers(spark, sf_dir).where("id in (1, 2, 3)").select("id")
    ranked = G.pagerank(suppliers(spark, sf_dir), edges(spark, sf_dir), iterations=5, tolerance=0.0, seeds=seeds)
    return ranked.select("id", F.round("score", 9).alias("score"))


@query("gcn_fallback", _pagerank_sql(5, UNIFORM) + ", n AS (SELECT id, round(s, 9) AS s FROM r5), m AS (SELECT id, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS c FROM n) SELECT id, CAST(floor(c * 6) AS BIGINT) AS class, round(c, 6) AS confidence FROM m")
def gcn_fallback(spark, sf_dir):
    """Classes without a model: PageRank scaled to [0, 1] and cut."""
    from tessera.operators.retrieval import score_classes

    ranked = G.pagerank(suppliers(spark, sf_dir), edges(spark, sf_dir), iterations=5, tolerance=0.0)
    return score_classes(ranked.withColumn("score", F.round("score", 9)), 7).select("id", "class", F.round("confidence", 6).alias("confidence"))


REACH = """, walk(id, source, distance) AS (SELECT id, id, 0 FROM v WHERE id IN ({sources})
    UNION SELECT e.dst, w.source, w.distance + 1 FROM walk w JOIN e ON e.src = w.id {where} AND w.distance < 8)"""


@query(
    "bfs_hops",
    WITH_RECURSIVE + REACH.format(sources="1", where="WHERE true") + " SELECT v.id, coalesce(min(w.distance), -1)::BIGINT AS distance, coalesce(min(w.source), -1)::BIGINT AS source FROM v LEFT JOIN walk w ON w.id = v.id GROUP BY v.id",
)
def bfs_hops(spark, sf_dir):
    return G.bfs(suppliers(spark, sf_dir), edges(spark, sf_dir), [1])


@query(
    "multi_bfs",
    WITH_RECURSIVE
    + REACH.format(sources="1, 2, 3", where="WHERE true")
    + " SELECT v.id, coalesce(min(w.distance), -1)::BIGINT AS distance, coalesce(arg_min(w.source, w.distance * 1000000 + w.source), -1)::BIGINT AS source FROM v LEFT JOIN walk w ON w.id = v.id GROUP BY v.id",
)
def multi_bfs(spark, sf_dir):
    return G.bfs(suppliers(spark, sf_dir), edges(spark, sf_dir), [1, 2, 3])


DAG_EDGES = WITH_RECURSIVE.replace("v AS MATERIALIZED", "g AS MATERIALIZED (SELECT * FROM e WHERE src < dst), v AS MATERIALIZED")


@query("reachable", DAG_EDGES + ", walk(id) AS (SELECT 50 UNION SELECT dst FROM walk JOIN g ON src = id) SELECT CAST(id AS BIGINT) AS id FROM walk WHERE id IN (SELECT id FROM v)")
def reachable(spark, sf_dir):
    return G.bfs(suppliers(spark, sf_dir), dag(spark, sf_dir), [50]).where("distance >= 0").select("id")


# customers and, as negative ids, their nation's whole-dollar balances
ACCOUNTS = """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT c_custkey AS src, -1 - ((c_nationkey + 1) * 100000 + CAST(floor(c_acctbal) AS BIGINT)) AS dst FROM customer),
v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"""


def account_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers linked to their nation's whole-dollar balance: many small components."""
    place = -1 - ((F.col("c_nationkey").cast("long") + 1) * 100000 + F.floor("c_acctbal"))
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), place.cast("long").alias("dst")).distinct()
    return found.select(F.col("src").alias("id")).unionByName(found.select(F.col("dst").alias("id"))).distinct(), found


@query(
    "connected_components",
    ACCOUNTS + " SELECT v.id, least(v.id, coalesce(min(e.dst), v.id)) AS component FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id",
)
def connected_components(spark, sf_dir):
    return G.connected_components(*account_graph(spark, sf_dir))


@query("strong_components", WITH_RECURSIVE + ", walk(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM walk JOIN e ON src = b) SELECT v.id, least(v.id, coalesce(min(x.b), v.id)) AS component FROM v LEFT JOIN (SELECT p.a, p.b FROM walk p JOIN walk q ON q.a = p.b AND q.b = p.a) x ON x.a = v.id GROUP BY v.id")
def strong_components(spark, sf_dir):
    return G.strong_components(suppliers(spark, sf_dir), edges(spark, sf_dir))


@query("largest_component", WITH_RECURSIVE + ", walk(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM walk JOIN e ON src = b), c AS (SELECT v.id, least(v.id, coalesce(min(x.b), v.id)) AS component FROM v LEFT JOIN (SELECT p.a, p.b FROM walk p JOIN walk q ON q.a = p.b AND q.b = p.a) x ON x.a = v.id GROUP BY v.id), s AS (SELECT component, count(*) AS n FROM c GROUP BY 1) SELECT count(*) AS components, arg_max(component, n * 1000000 - component) AS largest, max(n) AS size, max(n) > 1 AS has_cycles FROM s")
def largest_component(spark, sf_dir):
    sizes = G.strong_components(suppliers(spark, sf_dir), edges(spark, sf_dir)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("components"),
        F.max_by("component", F.struct("n", -F.col("component"))).alias("largest"),
        F.max("n").alias("size"),
        (F.max("n") > 1).alias("has_cycles"),
    )


@query("cycle_nodes", WITH_RECURSIVE + ", walk(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM walk JOIN e ON src = b) SELECT p.a AS id, min(p.b) AS component FROM walk p JOIN walk q ON q.a = p.b AND q.b = p.a GROUP BY p.a")
def cycle_nodes(spark, sf_dir):
    return G.cycle_nodes(suppliers(spark, sf_dir), edges(spark, sf_dir))


@query("condensation", WITH_RECURSIVE + ", walk(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM walk JOIN e ON src = b), c AS (SELECT v.id, least(v.id, coalesce(min(x.b), v.id)) AS component FROM v LEFT JOIN (SELECT p.a, p.b FROM walk p JOIN walk q ON q.a = p.b AND q.b = p.a) x ON x.a = v.id GROUP BY v.id) SELECT DISTINCT a.component AS src, b.component AS dst FROM e JOIN c a ON a.id = e.src JOIN c b ON b.id = e.dst WHERE a.component <> b.component")
def condensation(spark, sf_dir):
    """Of the whole graph, cycles and all; where it is one strong component, no edge is left."""
    return G.condensation(suppliers(spark, sf_dir), edges(spark, sf_dir))


@query("break_cycles", WITH + ", k AS (SELECT src, count(*) AS n, min(dst) AS dst FROM e GROUP BY src) SELECT src, dst FROM k ORDER BY n DESC, src LIMIT 1")
def break_cycles(spark, sf_dir):
    return G.break_cycles(suppliers(spark, sf_dir), edges(spark, sf_dir))


LEVELS = DAG_EDGES + ", walk(id, level) AS (SELECT id, 0 FROM v UNION SELECT dst, level + 1 FROM walk JOIN g ON src = id)"


@query("topological_levels", LEVELS + ", l AS (SELECT id, CAST(max(level) AS BIGINT) AS level FROM walk GROUP BY id) SELECT id, level, row_number() OVER (ORDER BY level, id) - 1 AS position FROM l")
def topological_levels(spark, sf_dir):
    return G.topological_levels(suppliers(spark, sf_dir), dag(spark, sf_dir))


@query("longest_path", LEVELS + " SELECT CAST(max(level) AS BIGINT) AS length FROM walk")
def longest_path(spark, sf_dir):
    return G.topological_levels(suppliers(spark, sf_dir), dag(spark, sf_dir)).agg(F.max("level").alias("length"))


@query(
    "critical_path",
    DAG_EDGES
    + """, f(id, t) AS (SELECT id, 0::BIGINT FROM v UNION SELECT g.dst, f.t + v.weight FROM f JOIN v ON v.id = f.id JOIN g ON g.src = f.id),
    b(id, t) AS (SELECT id, weight::BIGINT FROM v UNION SELECT g.src, b.t + v.weight FROM b JOIN g ON g.dst = b.id JOIN v ON v.id = g.src),
    x AS (SELECT f.id, max(f.t) AS early FROM f GROUP BY 1), y AS (SELECT id, max(t) AS tail FROM b GROUP BY 1)
    SELECT x.id, CAST(early AS DOUBLE) AS earliest, CAST((SELECT max(tail) FROM y) - tail AS DOUBLE) AS latest,
    CAST((SELECT max(tail) FROM y) - tail - early AS DOUBLE) AS slack, (SELECT max(tail) FROM y) - tail - early = 0 AS critical FROM x JOIN y USING (id)""",
)
def critical_path(spark, sf_dir):
    return G.critical_path(suppliers(spark, sf_dir), dag(spark, sf_dir))


@query("dag_shortest_path", DAG_EDGES + ", w(id, c) AS (SELECT 1::BIGINT, 0::BIGINT UNION SELECT g.dst, w.c + v.weight FROM w JOIN g ON g.src = w.id JOIN v ON v.id = g.dst WHERE w.c < 30) SELECT v.id, CAST(min(w.c) AS DOUBLE) AS cost FROM v LEFT JOIN w ON w.id = v.id GROUP BY v.id")
def dag_shortest_path(spark, sf_dir):
    return G.dag_shortest_path(suppliers(spark, sf_dir), dag(spark, sf_dir), 1).select("id", "cost")


@query("depth_first")
def depth_first(spark, sf_dir):
    return G.depth_first(suppliers(spark, sf_dir), edges(spark, sf_dir))


@query("louvain")
def louvain(spark, sf_dir):
    return G.louvain(suppliers(spark, sf_dir), edges(spark, sf_dir))


COMMUNITY = WITH + ", c AS (SELECT s_suppkey AS id, s_nationkey AS community FROM supplier), x AS (SELECT a.community AS cs, b.community AS cd, e.* FROM e JOIN c a ON a.id = src JOIN c b ON b.id = dst)"


@query(
    "community_stats",
    COMMUNITY
    + """, s AS (SELECT community, count(*) AS n FROM c GROUP BY 1), w AS (SELECT cs, sum(CASE WHEN cs = cd THEN weight ELSE 0 END) / 2.0::DOUBLE AS i, sum(weight)::DOUBLE AS t FROM x GROUP BY 1)
    SELECT community, n AS size, coalesce(i, 0) AS internal_weight, coalesce(t, 0) AS total_weight, CASE WHEN n > 1 THEN round(coalesce(i, 0) / (n * (n - 1) / 2), 6) ELSE 1.0 END AS density
    FROM s LEFT JOIN w ON cs = community""",
)
def community_stats(spark, sf_dir):
    return G.community_stats(edges(spark, sf_dir), communities(spark, sf_dir)).withColumn("density", F.round("density", 6))


@query("inter_community_edges", COMMUNITY + " SELECT cs AS c1, cd AS c2, sum(weight)::DOUBLE AS weight FROM x WHERE cs <> cd GROUP BY 1, 2")
def inter_community_edges(spark, sf_dir):
    return G.inter_community(edges(spark, sf_dir), communities(spark, sf_dir))


@query(
    "edge_modularity",
    COMMUNITY
    + """, k AS (SELECT src, sum(weight) AS k FROM e GROUP BY 1), m AS (SELECT sum(weight)::DOUBLE AS m2 FROM e)
    SELECT round((SELECT sum((weight - a.k * b.k / m2) / m2) FROM x JOIN k a ON a.src = x.src JOIN k b ON b.src = x.dst, m WHERE cs = cd), 6) AS edge_modularity,
    round((SELECT sum(weight / m2) FROM x, m WHERE cs = cd) - (SELECT sum((k / m2) ^ 2) FROM (SELECT community, sum(k) AS k FROM c JOIN k ON src = id GROUP BY 1), m), 6) AS modularity""",
)
def edge_modularity(spark, sf_dir):
    found = G.edge_modularity(edges(spark, sf_dir), communities(spark, sf_dir))
    return found.select(F.round("edge_modularity", 6).alias("edge_modularity"), F.round("modularity", 6).alias("modularity"))


@query("community_count", "SELECT count(DISTINCT s_nationkey) AS communities FROM supplier")
def community_count(spark, sf_dir):
    return communities(spark, sf_dir).agg(F.countDistinct("community").alias("communities"))


@query("community_renumbered", "WITH f AS (SELECT s_nationkey AS community, min(s_suppkey) AS first FROM supplier GROUP BY 1), r AS (SELECT community, row_number() OVER (ORDER BY first) - 1 AS number FROM f) SELECT s_suppkey AS id, number FROM supplier JOIN r ON community = s_nationkey")
def community_renumbered(spark, sf_dir):
    given = communities(spark, sf_dir)
    first = given.groupBy("community").agg(F.min("id").alias("first"))
    numbered = ranked(first, ["first"], "number").select("community", "number")
    return given.join(numbered, "community").select("id", "number")


# suppliers in chains of seven: 0-1-..-6, 7-8-..-13 and so on
CHAIN = "WITH v AS (SELECT s_suppkey AS id, s_suppkey // 7 AS g, s_suppkey % 7 AS k FROM supplier), n AS (SELECT g, count(*) AS size, min(id) AS low, max(id) AS high FROM v GROUP BY g)"


def chains(spark: SparkSession, sf_dir: str, closed: bool = False, linked: bool = False) -> tuple[DataFrame, DataFrame]:
    """Suppliers in chains of seven; ``closed`` makes rings of them, ``linked`` leads from the first of one to the first of the next."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    group = F.floor(F.col("id") / 7)
    last = nodes.groupBy(group.alias("g")).agg(F.max("id").alias("high"), F.min("id").alias("low"))
    edges = nodes.where("id % 7 > 0").select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    if closed:
        edges = edges.unionByName(last.where("high > low").select(F.col("high").alias("src"), F.col("low").alias("dst")))
    if linked:
        edges = edges.unionByName(last.where("low > 0").select((F.col("low") - 7).alias("src"), F.col("low").alias("dst")))
    return nodes, edges


@query("chain_components", CHAIN + " SELECT id, low AS component FROM v JOIN n USING (g)")
def chain_components(spark, sf_dir):
    """Components of many hops."""
    return G.connected_components(*chains(spark, sf_dir))


@query("ring_components", CHAIN + " SELECT id, low AS component FROM v JOIN n USING (g)")
def ring_components(spark, sf_dir):
    """Rings that lead from one to the next: each is a strong component."""
    return G.strong_components(*chains(spark, sf_dir, closed=True, linked=True))


@query("ring_condensation", CHAIN + " SELECT a.low AS src, b.low AS dst FROM n a JOIN n b ON b.g = a.g + 1")
def ring_condensation(spark, sf_dir):
    return G.condensation(*chains(spark, sf_dir, closed=True, linked=True))


@query("ring_cycles", CHAIN + " SELECT low AS component, size, id FROM v JOIN n USING (g) WHERE size > 1")
def ring_cycles(spark, sf_dir):
    """The members of every cycle."""
    return G.cycles(*chains(spark, sf_dir, closed=True, linked=True))


@query("ring_breaks", CHAIN + " SELECT low AS src, low + 1 AS dst FROM n WHERE size > 1")
def ring_breaks(spark, sf_dir):
    """One edge of each ring: the first one of its least node, as all have one inner edge."""
    return G.break_cycles(*chains(spark, sf_dir, closed=True))


@query("depth_first_chain", CHAIN + ", o AS (SELECT *, CAST(sum(size) OVER (ORDER BY g) - size AS BIGINT) AS before FROM n) SELECT id, CASE WHEN k = 0 THEN -1 ELSE id - 1 END AS parent, 2 * before + k AS discovery, 2 * before + 2 * size - 1 - k AS finish FROM v JOIN o USING (g)")
def depth_first_chain(spark, sf_dir):
    """Chains have closed forms of both times."""
    return G.depth_first(*chains(spark, sf_dir))


@query("louvain_cliques", "WITH v AS (SELECT s_suppkey AS id, s_suppkey // 5 AS g FROM supplier) SELECT id, min(id) OVER (PARTITION BY g) AS community FROM v")
def louvain_cliques(spark, sf_dir):
    """Separate cliques of five are the communities."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    group = F.floor(F.col("id") / 5).alias("g")
    pairs = nodes.select(group, F.col("id").alias("src")).join(nodes.select(group, F.col("id").alias("dst")), "g").where("src <> dst")
    return G.louvain(nodes, pairs.select("src", "dst"))


@query("bfs_parents", CHAIN + " SELECT id, CASE WHEN g = 0 THEN k ELSE -1 END AS distance, CASE WHEN g = 0 AND k > 0 THEN id - 1 ELSE -1 END AS parent FROM v")
def bfs_parents(spark, sf_dir):
    return G.bfs_tree(*chains(spark, sf_dir), 0)


@query("bfs_path", "SELECT i AS step, i AS id FROM range(0, 7) t(i)")
def bfs_path(spark, sf_dir):
    return G.bfs_path(*chains(spark, sf_dir), 0, 6)


@query("levels_joined", CHAIN + ", l AS (SELECT id, k AS level FROM v) SELECT id, level, row_number() OVER (ORDER BY level, id) - 1 AS position FROM l")
def levels_joined(spark, sf_dir):
    """Topological levels by joins: no task holds the graph."""
    return G.topological_levels(*chains(spark, sf_dir), one_task=False)


@query("critical_path_joined", CHAIN + ", t AS (SELECT *, (SELECT CAST(max(size) AS DOUBLE) FROM n) AS total FROM v JOIN n USING (g)) SELECT id, CAST(k AS DOUBLE) AS earliest, total - (size - k) AS latest, total - size AS slack, total = size AS critical FROM t")
def critical_path_joined(spark, sf_dir):
    return G.critical_path(*chains(spark, sf_dir), one_task=False)


@query("shortest_path_joined", CHAIN + " SELECT id, CASE WHEN g = 0 THEN CAST(k AS DOUBLE) END AS cost, CASE WHEN g = 0 AND k > 0 THEN id - 1 ELSE -1 END AS parent FROM v")
def shortest_path_joined(spark, sf_dir):
    return G.dag_shortest_path(*chains(spark, sf_dir), 0, one_task=False)
