"""Graphs that are split into weak components beyond the bound of one task, against one task and brute force."""

import numpy as np
import pytest

from tessera.operators import graph as G


@pytest.fixture
def split(monkeypatch):
    """Graphs of more than 5 edges do not fit one task, and small components share groups of 30 edges."""
    for name, value in (("ONE_TASK_EDGES", 5), ("GROUP_EDGES", 30)):
        monkeypatch.setattr(G, name, value)


def islands(spark, rising=False):
    """Three dense islands, a chain, and nodes without edges; ids of the islands lie between each other."""
    rng = np.random.default_rng(7)
    pairs = {(int(a), int(b)) for k in range(3) for a, b in rng.integers(0, 10, (45, 2)) * 3 + k if a != b and (a < b or not rising)}
    pairs |= {(i, i + 1) for i in range(40, 45)}
    return spark.createDataFrame([(i, i % 5 + 1) for i in range(50)], "id long, weight int"), spark.createDataFrame(sorted(pairs), "src long, dst long"), pairs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_operators_by_component(spark, split, monkeypatch):
    nodes, edges, _ = islands(spark)
    _, rising, _ = islands(spark, rising=True)
    runs = {
        "strong_components": lambda: G.strong_components(nodes, edges),
        "cycle_nodes": lambda: G.cycle_nodes(nodes, edges),
        "depth_first": lambda: G.depth_first(nodes, edges),
        "depth_first from one": lambda: G.depth_first(nodes, edges, source=4),
        "louvain": lambda: G.louvain(nodes, edges),
        "topological_levels": lambda: G.topological_levels(nodes, rising),
        "critical_path": lambda: G.critical_path(nodes, rising),
        "dag_shortest_path": lambda: G.dag_shortest_path(nodes, rising, 1),
    }
    apart = {k: rows(run()) for k, run in runs.items()}
    monkeypatch.setattr(G, "ONE_TASK_EDGES", 2_000_000)
    for name, run in runs.items():
        assert apart[name] == rows(run()), name


def test_joined_components_keep_their_columns(spark):
    nodes, edges, _ = islands(spark)
    assert G.strong_components(nodes, edges, one_task=False).columns == ["id", "component"]


@pytest.mark.parametrize("colours", [False, True])
def test_triangles_by_component(spark, split, monkeypatch, colours):
    if colours:  # no component fits a task
        monkeypatch.setattr(G, "TRIANGLE_EDGES", 20)
    nodes, edges, pairs = islands(spark)
    links = {u: sum((u, x) in pairs and (u, y) in pairs for x, y in pairs if u not in (x, y)) for u in range(50)}
    assert {r.id: r.links for r in G.triangle_links(edges).collect()} == {u: n for u, n in links.items() if n}
    rising = sum((a, b) in pairs and (b, c) in pairs and (a, c) in pairs for a in range(30) for b in range(a, 30) for c in range(b, 30))
    assert G.global_clustering(nodes, edges).first().triangles == rising


def test_dense_and_sparse_counts_agree(monkeypatch):
    rng = np.random.default_rng(3)
    src, dst = rng.integers(0, 40, (2, 900))
    src, dst = src[src != dst], dst[src != dst]  # parallel edges among them
    zero = np.zeros(len(src), np.int64)
    dense = G._count_links(src, dst, zero, zero)
    monkeypatch.setattr(G, "DENSE_NODES", 0)
    monkeypatch.setattr(G, "WEDGES", 100)
    sparse = G._count_links(src, dst, zero, zero)
    assert (dense[0] == sparse[0]).all() and (dense[1] == sparse[1]).all() and dense[1].sum() > 0


def test_condensation_query_joins_cycles(spark, tmp_path):
    """Suppliers 1 and 2 follow each other both ways: one component, with an edge to 3."""
    from tessera.plans.catalogue import oracle_sql, queries

    lines = [(1, 1, 1, 1), (1, 1, 2, 2), (1, 1, 1, 3), (1, 1, 3, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, 0) for i in (1, 2, 3)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert rows(queries()["condensation"](spark, str(tmp_path))) == [(1, 3)]
    import duckdb

    duck = duckdb.connect()
    for t in ("lineitem", "supplier"):
        duck.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert duck.execute(oracle_sql()["condensation"]).fetchall() == [(1, 3)]
