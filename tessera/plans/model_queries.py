"""Queries of models, incremental parsing, change feeds, batches and shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import inference as I
from tessera.plans import graph_queries as Q
from tessera.plans.catalogue import query
from tessera.plans.stream_queries import _drained, _event_stream
from tessera.session import table
from tessera.sources import dataset as D
from tessera.streaming import incremental as N

MODEL_SQL = """f AS (SELECT s_suppkey AS id, [CAST(s_nationkey % 3 AS DOUBLE), CAST(s_nationkey % 2 AS DOUBLE) * 1.5] AS x FROM supplier),
p AS (SELECT id, exp(x[1]) / (exp(x[1]) + exp(x[2])) AS a, exp(x[2]) / (exp(x[1]) + exp(x[2])) AS b FROM f)"""


def _features(spark, sf_dir):
    values = F.array((F.col("s_nationkey") % 3).cast("double"), (F.col("s_nationkey") % 2).cast("double") * 1.5)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), values.alias("values"))


@query("node_classes", f"WITH {MODEL_SQL} SELECT id, CAST(CASE WHEN a >= b THEN 0 ELSE 1 END AS BIGINT) AS class, round(greatest(a, b), 6) AS confidence FROM p")
def node_classes(spark, sf_dir):
    """A model that hands its features on: softmax, likeliest class and confidence."""
    logits = I.node_logits(_features(spark, sf_dir), Q.chains(spark, sf_dir)[1], lambda x, src, dst: x)
    return I.classified(logits).select("id", F.col("class").cast("long").alias("class"), F.round("confidence", 6).alias("confidence"))


@query("predicted_links", f"WITH {MODEL_SQL} SELECT x.id AS src, y.id AS dst, round(1 / (1 + exp(-(x.a * y.a + x.b * y.b))), 6) AS score FROM p x JOIN p y ON y.id = x.id + 1")
def predicted_links(spark, sf_dir):
    found = I.classified(I.node_logits(_features(spark, sf_dir), Q.chains(spark, sf_dir)[1], lambda x, src, dst: x))
    pairs = found.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return I.predicted_links(found, pairs).select("src", "dst", F.round("score", 6).alias("score"))


@query(
    "graph_convolution",
    """WITH v AS (SELECT s_suppkey AS id, s_suppkey % 7 AS k, (s_suppkey // 7) AS g, CAST(s_nationkey AS DOUBLE) AS x FROM supplier), d AS (SELECT *, CASE WHEN k = 0 THEN 1.0 ELSE 2.0 END AS deg FROM v)
    SELECT a.id, round(a.x / a.deg + coalesce(b.x / sqrt(a.deg * b.deg), 0), 6) AS value FROM d a LEFT JOIN d b ON b.id = a.id - 1 AND b.g = a.g""",
)
def graph_convolution(spark, sf_dir):
    """One layer with the weight 1 over chains, part by part: every node with its in-neighbour."""
    nodes, edges = Q.chains(spark, sf_dir)
    features = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.array(F.col("s_nationkey").cast("double")).alias("values"))
    out = I.node_logits_by_part(features, edges, I.convolution([np.ones((1, 1))]), 4, hops=2)
    return out.select("id", F.round(F.get("logits", 0), 6).alias("value"))


@query(
    "incremental_events",
    """WITH e AS (SELECT event_id AS sid, event_type AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT sid, 'key' AS event, 'k' AS path, 'k' AS value FROM e UNION ALL SELECT sid, 'key', 'list', 'list' FROM e UNION ALL SELECT sid, 'key', 'name', 'name' FROM e
    UNION ALL SELECT sid, 'value', 'k', CAST(k AS VARCHAR) FROM e UNION ALL SELECT sid, 'value', 'list.0', '1' FROM e UNION ALL SELECT sid, 'value', 'list.1', '"a b"' FROM e UNION ALL SELECT sid, 'value', 'name', '"' || t || '"' FROM e
    UNION ALL SELECT sid, 'start_object', '', NULL FROM e UNION ALL SELECT sid, 'end_object', '', NULL FROM e UNION ALL SELECT sid, 'start_list', 'list', NULL FROM e UNION ALL SELECT sid, 'end_list', 'list', NULL FROM e""",
)
def incremental_events(spark, sf_dir):
    """Text that is cut anywhere: the state of each stream's parser goes from piece to piece."""
    k = F.get_json_object("props", "$.k")
    pieces = F.array(F.concat(F.lit("{k="), F.substring(k, 1, 1)), F.concat(F.expr("substring(get_json_object(props, '$.k'), 2)"), F.lit(' list=[1 "a')), F.lit(' b"] na'), F.concat(F.lit("me="), "event_type"), F.lit("}"))
    given = _event_stream(spark, sf_dir).select(F.col("event_id").alias("sid"), F.posexplode(pieces).alias("seq", "piece"))
    given = given.select("sid", F.col("seq").cast("long").alias("seq"), "piece", (F.col("seq") == 4).alias("last"))
    return _drained(N.parse_events(given)).where("event <> 'need_more'").select("sid", "event", "path", "value")


@query(
    "graph_change_feed",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op, event_type AS p FROM events),
    l AS (SELECT *, lag(op) OVER w AS before, lag(p) OVER w AS old FROM e WINDOW w AS (PARTITION BY id ORDER BY seq))
    SELECT id, seq, op, (op <> 'delete') <> (coalesce(before, 'delete') <> 'delete') OR (op <> 'delete' AND p <> old) AS changed, CASE WHEN op <> 'delete' THEN p END AS props FROM l""",
)
def graph_change_feed(spark, sf_dir):
    """Upserts and deletes against the latest state of each node."""
    op = F.when(F.col("event_id") % 5 == 0, "delete").otherwise("upsert")
    given = _event_stream(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_type").alias("props"))
    return _drained(N.change_feed(given))


@query("event_batches", "SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS batch FROM events")
def event_batches(spark, sf_dir):
    """Events in batches of one kind, as a loader writes them."""
    return N.batches_of(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 100).select("event_id", F.col("batch").cast("long").alias("batch"))


@query("graph_shards", "SELECT (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM orders) AS edges, 'Customer' AS labels, (SELECT CAST(sum(o_custkey + o_orderkey) AS BIGINT) FROM orders) AS ends")
def graph_shards(spark, sf_dir):
    """Customers and their orders in eight shards, and what they hold."""
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("Customer")).alias("labels"), F.to_json(F.struct("c_nationkey")).alias("props"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("PLACED").alias("type"), F.lit(None).cast("string").alias("props"))
    shards = D.graph_shards(nodes, edges, 8, {"made_of": "customers"})
    ends = F.aggregate("links", F.lit(0).cast("long"), lambda s, x: s + x["src"].cast("long") + x["dst"].cast("long"))
    return D.shard_contents(shards).agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"), F.max(F.array_join("labels", ",")).alias("labels"), F.sum(ends).alias("ends"))
