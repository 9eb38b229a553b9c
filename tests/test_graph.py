"""Graph operators on hand graphs with values worked out by hand, and both plans of the iterative ones."""

import numpy as np
import pytest

from tessera.operators import graph as G


def graph(spark, n, edges):
    return spark.range(n), spark.createDataFrame([(a, b) for a, b in edges], "src long, dst long")


def by_id(df, column):
    return {r.id: r[column] for r in df.collect()}


CYCLE3 = [(0, 1), (1, 2), (2, 0)]
CHAIN4 = [(0, 1), (1, 2), (2, 3)]
STAR = [(1, 0), (2, 0), (3, 0)]
BRIDGE = [(a, b) for x, y in [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)] for a, b in [(x, y), (y, x)]]


@pytest.mark.parametrize("one_task", [True, False])
def test_pagerank_plans(spark, one_task):
    score = by_id(G.pagerank(*graph(spark, 3, CYCLE3), one_task=one_task), "score")
    assert all(v == pytest.approx(1 / 3) for v in score.values())
    score = by_id(G.pagerank(*graph(spark, 4, STAR), iterations=6, one_task=one_task), "score")
    assert sum(score.values()) == pytest.approx(1) and max(score, key=score.get) == 0
    seeds = spark.createDataFrame([(0,), (0,), (99,)], "id long")
    score = by_id(G.pagerank(*graph(spark, 4, CHAIN4), iterations=4, seeds=seeds, one_task=one_task), "score")
    assert sum(score.values()) == pytest.approx(1) and score[0] > score[1] > score[2] > score[3]


def test_plans_agree(spark):
    rng = np.random.default_rng(1)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 30, (60, 2))]
    nodes, e = graph(spark, 30, edges)
    a, b = (by_id(G.pagerank(nodes, e, iterations=3, one_task=k), "score") for k in (True, False))
    assert all(a[i] == pytest.approx(b[i]) for i in a)
    assert by_id(G.strong_components(nodes, e, True), "component") == by_id(G.strong_components(nodes, e, False), "component")


def test_traversal_and_components(spark):
    nodes, edges = graph(spark, 5, CHAIN4)
    assert by_id(G.bfs(nodes, edges, [0]), "distance") == {0: 0, 1: 1, 2: 2, 3: 3, 4: -1}
    assert by_id(G.bfs(nodes, edges, [0, 2]), "source") == {0: 0, 1: 0, 2: 2, 3: 2, 4: -1}
    assert by_id(G.connected_components(nodes, edges), "component") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    found = {r.id: r for r in G.depth_first(*graph(spark, 4, [(0, 1), (1, 2), (0, 3)]), source=0).collect()}
    assert (found[0].discovery, found[0].finish, found[3].discovery, found[3].parent) == (0, 7, 5, 0)


def test_strong_components_and_cycles(spark):
    nodes, edges = graph(spark, 4, [(0, 1), (1, 0), (1, 2), (2, 3), (3, 2)])
    assert by_id(G.strong_components(nodes, edges), "component") == {0: 0, 1: 0, 2: 2, 3: 2}
    assert [tuple(r) for r in G.condensation(nodes, edges).collect()] == [(0, 2)]
    assert sorted(by_id(G.cycle_nodes(*graph(spark, 4, [(0, 1), (1, 2), (2, 0), (0, 3), (3, 3)])), "component")) == [0, 1, 2, 3]
    assert len(G.break_cycles(nodes, edges).collect()) == 2


def test_acyclic_operators(spark):
    nodes, edges = graph(spark, 4, [(0, 1), (0, 2), (1, 3), (2, 3)])
    weighted = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 2.0), (3, 1.0)], "id long, weight double")
    path = {r.id: r for r in G.critical_path(weighted, edges).collect()}
    assert [path[i].earliest for i in range(4)] == [0, 1, 1, 6] and [path[i].critical for i in range(4)] == [True, True, False, True]
    assert by_id(G.topological_levels(nodes, edges), "level") == {0: 0, 1: 1, 2: 1, 3: 2}
    assert by_id(G.dag_shortest_path(weighted, edges, 0), "cost") == {0: 0, 1: 5, 2: 2, 3: 3}
    with pytest.raises(Exception, match="cycle"):
        G.topological_levels(*graph(spark, 3, CYCLE3)).collect()


def test_metrics(spark):
    nodes, edges = graph(spark, 4, STAR)
    m = G.graph_metrics(nodes, edges).first()
    assert (m.num_nodes, m.num_edges, m.no_out_edges, m.isolated, m.sources, m.sinks) == (4, 3, 1, 0, 3, 1)
    assert by_id(G.local_clustering(*graph(spark, 3, [(a, b) for a in range(3) for b in range(3) if a != b])), "coefficient") == {0: 1, 1: 1, 2: 1}
    hub = [(0, i) for i in range(1, 12)] + [(i, 0) for i in range(1, 12)]
    assert by_id(G.degree_anomalies(*graph(spark, 12, hub)), "anomaly")[0] == "hub"
    assert G.degree_anomalies(*graph(spark, 2, [])).count() == 2
    assert {r.src for r in G.undirected(edges).collect()} == {0, 1, 2, 3}
    assert G.self_loops_added(nodes, spark.createDataFrame([(0, 0)], "src long, dst long")).count() == 4
    assert [tuple(r) for r in G.csr_row_pointers(*graph(spark, 3, [(0, 1), (0, 2), (2, 1)])).orderBy("id").collect()] == [(0, 0, 2), (1, 2, 2), (2, 2, 3)]


def test_louvain_finds_two_triangles(spark):
    nodes, edges = graph(spark, 6, BRIDGE)
    found = by_id(G.louvain(nodes, edges), "community")
    assert found[0] == found[1] == found[2] != found[3] == found[4] == found[5]
    from pyspark.sql import functions as F

    parts = spark.createDataFrame(list(found.items()), "id long, community long")
    q = G.edge_modularity(edges.withColumn("weight", F.lit(1)), parts).first()
    assert q.modularity == pytest.approx(5 / 14, abs=1e-6)
