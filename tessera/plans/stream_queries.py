"""Streaming and wire-format queries; each streaming result equals the batch replay in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.catalogue import query
from tessera.plans.ordered_queries import FRAMES
from tessera.session import table
from tessera.sources import wire
from tessera.streaming import frames as SF
from tessera.streaming import validator as SV


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet in the shared folder, and read it."""
    spark = stream.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        shared = tempfile.mkdtemp(prefix="tessera-streams-")
    base = f"{shared}/stream-{uuid.uuid4().hex}"
    sink = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
    running = sink.trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


@query(
    "stream_frame_states",
    f"""WITH {FRAMES}, t AS (SELECT *, max(seq) OVER (PARTITION BY sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM frames)
    SELECT sid, pos, seq, CASE WHEN top IS NULL THEN 'first' WHEN seq <= top THEN 'duplicate' WHEN seq > top + 1 THEN 'gap' ELSE 'ok' END AS status FROM t""",
)
def stream_frame_states(spark, sf_dir):
    seq = F.floor(F.col("event_id") / 100) + F.floor(F.col("value")) % 3
    given = _event_stream(spark, sf_dir).select(F.col("user_id").alias("sid"), seq.cast("long").alias("seq"), F.col("event_id").alias("pos"))
    return _drained(SF.classify_frames(given))


@query("stream_event_windows", "SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS start, count(*) AS n FROM events GROUP BY time_bucket(INTERVAL 1 DAY, ts) HAVING time_bucket(INTERVAL 1 DAY, ts) < (SELECT time_bucket(INTERVAL 1 DAY, max(ts) - INTERVAL 1 HOUR) FROM events)")
def stream_event_windows(spark, sf_dir):
    """Windows that the watermark has closed, in append mode."""
    given = _event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return _drained(given.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"))


TOOLS = {
    "calculate": {"k": SV.Argument("int", required=True, minimum=0, maximum=49), "unit": SV.Argument(enum=("click", "view", "purchase"))},
    "search": {"k": SV.Argument("int", required=True), "unit": SV.Argument()},
}


@query(
    "token_stream_validator",
    """WITH t AS (SELECT event_id AS stream_id, CASE event_id % 3 WHEN 0 THEN 'calculate' WHEN 1 THEN 'search' ELSE 'shell' END AS tool, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events)
    SELECT stream_id, tool, CAST(CASE WHEN tool = 'shell' THEN 0 ELSE 2 END AS BIGINT) AS n_fields, tool <> 'shell' AND NOT (tool = 'calculate' AND (k > 49 OR event_type NOT IN ('click', 'view', 'purchase'))) AS valid, tool <> 'shell' AS complete FROM t""",
)
def token_stream_validator(spark, sf_dir):
    tool = F.element_at(F.array(F.lit("calculate"), F.lit("search"), F.lit("shell")), (F.col("event_id") % 3 + 1).cast("int"))
    pieces = F.array(tool, F.lit("{"), F.lit("k="), F.get_json_object("props", "$.k"), F.lit(" un"), F.concat(F.lit('it="'), F.col("event_type")), F.lit('"}'))
    tokens = table(spark, sf_dir, "events").select(F.col("event_id").alias("stream_id"), F.posexplode(pieces).alias("pos", "token"))
    return SV.validate_streams(tokens, TOOLS).drop("errors")


@query("wire_round_trip", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'gen2' AS kind FROM events")
def wire_round_trip(spark, sf_dir):
    coded = table(spark, sf_dir, "events").select("event_id", wire.to_wire("props").alias("document"))
    return coded.select("event_id", F.get_json_object(wire.wire_to_json("document"), "$.k").cast("long").alias("k"), wire.sniff(F.col("document")).alias("kind"))
