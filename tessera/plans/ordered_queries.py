"""Queries over ordered data: the value series of each user and change logs, both from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ordered as O
from tessera.plans.catalogue import query
from tessera.session import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of a user's properties; an error deletes the user."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    prop = F.get_json_object("props", "$.k").cast("long")
    purchase = F.when(F.col("event_type") == "purchase", F.col("value"))
    return events(spark, sf_dir).select("event_id", "user_id", "event_type", op.alias("op"), prop.alias("k"), F.col("value"), purchase.alias("spent"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A framed stream for each user: sequence numbers repeat and skip as values fall."""
    seq = F.floor(F.col("event_id") / 100) + F.floor(F.col("value")) % 3
    return events(spark, sf_dir).select(F.col("user_id").alias("sid"), seq.cast("long").alias("seq"), F.col("event_id").alias("pos"), "event_type")


RESIDUALS = """SELECT event_id, user_id, value, lag(value) OVER w AS a, lag(value, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""
RES = f"SELECT event_id, user_id, value, CASE WHEN a IS NULL THEN value ELSE value - a END AS delta, CASE WHEN a IS NULL THEN value WHEN b IS NULL THEN value - a ELSE value - (2 * a - b) END AS linear FROM ({RESIDUALS})"


@query("lag_residuals", f"SELECT event_id, round(delta, 6) AS delta, round(linear, 6) AS linear FROM ({RES})")
def lag_residuals(spark, sf_dir):
    found = O.residuals(events(spark, sf_dir).select("event_id", "user_id", "value"), "user_id", "event_id", "value")
    return found.select("event_id", F.round("delta", 6).alias("delta"), F.round("linear", 6).alias("linear"))


@query("predictor_choice", f"SELECT user_id, count(*) AS n, CASE WHEN count(*) < 3 THEN 'none' WHEN var_pop(value) <= var_pop(delta) AND var_pop(value) <= var_pop(linear) THEN 'none' WHEN var_pop(delta) <= var_pop(linear) THEN 'delta' ELSE 'linear' END AS predictor FROM ({RES}) GROUP BY user_id")
def predictor_choice(spark, sf_dir):
    return O.choose_predictor(events(spark, sf_dir).select("event_id", "user_id", "value"), "user_id", "event_id", "value")


CORR = f"SELECT user_id, CASE WHEN count(*) < 3 THEN 0 ELSE coalesce(corr(a, value), 0) END AS c, count(*) AS n FROM ({RESIDUALS}) GROUP BY user_id"


@query("lag_correlation", f"SELECT user_id, round(c, 6) AS correlation FROM ({CORR})")
def lag_correlation(spark, sf_dir):
    return O.lag_correlation(events(spark, sf_dir), "user_id", "event_id", "value").select("user_id", F.round("correlation", 6).alias("correlation"))


@query("should_use_delta", f"SELECT user_id, n >= 8 AND abs(c) > 0.1 AS use_delta FROM ({CORR})")
def should_use_delta(spark, sf_dir):
    return O.should_use_delta(events(spark, sf_dir), "user_id", "event_id", "value", 0.1)


@query(
    "rle_runs",
    """WITH m AS (SELECT user_id, event_id, event_type AS value, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run FROM m)
    SELECT user_id, CAST(run AS BIGINT) AS run, min(value) AS value, count(*) AS length, min(event_id) AS first FROM r GROUP BY user_id, run""",
)
def rle_runs(spark, sf_dir):
    return O.rle_runs(events(spark, sf_dir), "user_id", "event_id", F.col("event_type"))


@query(
    "quantise_levels",
    """SELECT event_id, CASE WHEN hi > lo THEN CAST(floor((value - lo) / (hi - lo) * 255) AS BIGINT) ELSE 0 END AS level,
    CASE WHEN hi > lo THEN round(lo + floor((value - lo) / (hi - lo) * 255) * (hi - lo) / 255, 6) ELSE lo END AS restored
    FROM (SELECT *, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)""",
)
def quantise_levels(spark, sf_dir):
    return O.quantise(events(spark, sf_dir), "user_id", "value", 8).select("event_id", "level", F.round("restored", 6).alias("restored"))


FRAMES = "frames AS (SELECT user_id AS sid, event_id // 100 + CAST(floor(value) AS BIGINT) % 3 AS seq, event_id AS pos, event_type FROM events)"


@query(
    "sequence_gaps",
    f"""WITH {FRAMES}, t AS (SELECT *, max(seq) OVER (PARTITION BY sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM frames)
    SELECT sid, pos, seq, CASE WHEN top IS NULL THEN 'first' WHEN seq <= top THEN 'duplicate' WHEN seq > top + 1 THEN 'gap' ELSE 'ok' END AS status FROM t""",
)
def sequence_gaps(spark, sf_dir):
    return O.sequence_status(frames(spark, sf_dir)).select("sid", "pos", "seq", "status")


@query(
    "pending_acks",
    f"""WITH {FRAMES}, p AS (SELECT sid, max(seq) AS hi, coalesce(max(seq) FILTER (event_type = 'click'), -1) AS lo FROM frames GROUP BY sid)
    SELECT sid, unnest(range(lo + 1, hi + 1)) AS seq FROM p""",
)
def pending_acks(spark, sf_dir):
    given = frames(spark, sf_dir)
    return O.pending_acks(given, given.where("event_type = 'click'"))


LOG = "log AS (SELECT event_id, user_id, event_type, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, CASE WHEN event_type = 'purchase' THEN value END AS spent FROM events)"
ALIVE = f"WITH {LOG}, g AS (SELECT user_id, max(event_id) FILTER (op = 'delete') AS gone FROM log GROUP BY 1), alive AS (SELECT log.* FROM log JOIN g USING (user_id) WHERE op <> 'delete' AND (gone IS NULL OR event_id > gone))"


@query("latest_state", f"{ALIVE} SELECT user_id, arg_max(k, event_id) AS k, arg_max(event_type, event_id) AS event_type FROM alive GROUP BY 1")
def latest_state(spark, sf_dir):
    return O.latest_state(change_log(spark, sf_dir), "user_id", "event_id", "op", ["k", "event_type"])


@query("latest_props", f"{ALIVE} SELECT user_id, arg_max(value, event_id) AS value, arg_max(spent, event_id) FILTER (spent IS NOT NULL) AS spent FROM alive GROUP BY 1")
def latest_props(spark, sf_dir):
    return O.latest_state(change_log(spark, sf_dir), "user_id", "event_id", "op", ["value", "spent"])


@query("triple_set", f"WITH {LOG} SELECT user_id, k FROM log GROUP BY 1, 2 HAVING arg_max(op, event_id) <> 'delete'")
def triple_set(spark, sf_dir):
    return O.assert_retract(change_log(spark, sf_dir), ["user_id", "k"], "event_id", "op")


@query("graph_counts", f"WITH {LOG}, n AS (SELECT count(*) AS nodes FROM ({ALIVE} SELECT DISTINCT user_id FROM alive)), t AS (SELECT count(*) AS triples FROM (SELECT user_id, k FROM log GROUP BY 1, 2 HAVING arg_max(op, event_id) <> 'delete')) SELECT nodes, triples FROM n, t")
def graph_counts(spark, sf_dir):
    log = change_log(spark, sf_dir)
    nodes = O.latest_state(log, "user_id", "event_id", "op", ["k"]).agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.join(F.broadcast(O.assert_retract(log, ["user_id", "k"], "event_id", "op").agg(F.count(F.lit(1)).alias("triples"))))


@query("loader_stats", f"WITH {LOG} SELECT event_type AS kind, count(*) FILTER (op <> 'delete') AS writes, count(*) FILTER (op = 'delete') AS deletes FROM log GROUP BY 1")
def loader_stats(spark, sf_dir):
    return O.loader_stats(change_log(spark, sf_dir), "event_type", "op")


@query("split_assignment", "SELECT vec_id, CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.6) + floor(n * 0.2) THEN 'validation' ELSE 'test' END AS split FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, count(*) OVER () AS n FROM embeddings)")
def split_assignment(spark, sf_dir):
    return O.prefix_split(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 0.6, 0.2)


@query("split_sizes", "SELECT split, count(*) AS n FROM (SELECT CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.6) + floor(n * 0.2) THEN 'validation' ELSE 'test' END AS split FROM (SELECT row_number() OVER (ORDER BY vec_id) AS r, count(*) OVER () AS n FROM embeddings)) GROUP BY 1")
def split_sizes(spark, sf_dir):
    return split_assignment(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Tumbling event-time windows, the batch form of the streaming change feed."""
    w = events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")
