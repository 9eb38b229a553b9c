"""Shards of more rows than a document holds, and binaries that cannot be read."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import dataset as D
from tessera.sources import wire


def test_large_shards_have_several_documents(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_ROWS", 20)
    nodes = spark.range(100).select("id", F.array(F.lit("N")).alias("labels"), F.lit(None).cast("string").alias("props"))
    edges = spark.range(300).select((F.col("id") % 100).alias("src"), F.col("id").alias("dst"), F.lit("E").alias("type"), F.lit(None).cast("string").alias("props"))
    shards = D.graph_shards(nodes, edges, 2)
    found = shards.select("shard", D.shard_counts("content").alias("c"), D.shard_edges("content").alias("e")).collect()
    assert {r.shard for r in found} == {0, 1} and len(found) > 2
    assert sum(r.c.nodes for r in found) == 100 and sum(r.c.edges for r in found) == 300
    assert sorted(int(e.dst) for r in found for e in r.e) == list(range(300))
    read = D.shard_contents(shards).collect()
    assert sorted(int(e.dst) for r in read for e in r.links) == list(range(300)) and {tuple(r.labels) for r in read} == {("N",)}


def test_an_unreadable_shard_is_an_error(spark):
    good = wire.encode(wire.Shard([wire.GraphNode("a", ["N"], {})], [], {}))
    given = spark.createDataFrame([(good,), (wire.encode([1]),), (None,)], "content binary")
    assert [r.c.nodes for r in given.select(D.shard_counts("content").alias("c")).collect()] == [1, None, None]
    for count in (D.shard_counts, D.shard_edges):
        with pytest.raises(Exception, match="ERR_TRUNCATED"):
            spark.createDataFrame([(good[:-1],)], "content binary").select(count("content")).collect()
