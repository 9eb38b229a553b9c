"""Order-dependent operators as windows: residuals, runs, gaps, acknowledgements and latest states.

Each window is partitioned by a key of the data; an operator over one long series takes a series id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def residuals(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Add ``delta`` (x[i] - x[i-1]) and ``linear`` (x[i] - (2 x[i-1] - x[i-2])) residuals; first values stand for themselves."""
    w = Window.partitionBy(key).orderBy(order)
    one, two, x = F.lag(value, 1).over(w), F.lag(value, 2).over(w), F.col(value)
    delta = F.when(one.isNull(), x).otherwise(x - one)
    linear = F.when(one.isNull(), x).when(two.isNull(), x - one).otherwise(x - (2 * one - two))
    return df.withColumns({"delta": delta, "linear": linear})


def choose_predictor(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, n, predictor): the residual of least population variance among none, delta and linear; under 3 values none."""
    r = residuals(df, key, order, value).groupBy(key)
    v = r.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(c).alias(a) for c, a in ((value, "a"), ("delta", "b"), ("linear", "c"))])
    pick = F.when(F.col("n") < 3, "none").when((F.col("a") <= F.col("b")) & (F.col("a") <= F.col("c")), "none").when(F.col("b") <= F.col("c"), "delta").otherwise("linear")
    return v.select(key, "n", pick.alias("predictor"))


def lag_correlation(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, correlation): Pearson of consecutive values; 0 under 3 values or without variance."""
    before = df.withColumn("_before", F.lag(value).over(Window.partitionBy(key).orderBy(order)))
    c = before.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.try_divide(F.covar_pop("_before", value), F.stddev_pop(F.when(F.col("_before").isNotNull(), F.col(value))) * F.stddev_pop("_before")).alias("_c"))
    return c.select(key, F.when(F.col("_n") < 3, 0.0).otherwise(F.coalesce("_c", F.lit(0.0))).alias("correlation"))


def should_use_delta(df: DataFrame, key: str, order: str, value: str, threshold: float = 0.5) -> DataFrame:
    """(key, use_delta): at least 8 values and an absolute lag correlation above the threshold."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return lag_correlation(df, key, order, value).join(n, key).select(key, ((F.col("_n") >= 8) & (F.abs("correlation") > threshold)).alias("use_delta"))


def rle_runs(df: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """(key, run, value, length, first): maximal runs of equal values in order."""
    w = Window.partitionBy(key).orderBy(order)
    v = df.select(key, F.col(order).alias("_at"), value.alias("value"))
    w = Window.partitionBy(key).orderBy("_at")
    v = v.withColumn("_new", (~F.col("value").eqNullSafe(F.lag("value").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    v = v.withColumn("run", F.sum("_new").over(w) - 1)
    return v.groupBy(key, "run").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("length"), F.min("_at").alias("first"))


def quantise(df: DataFrame, key: str, value: str, bits: int) -> DataFrame:
    """Add ``level`` (0 to 2**bits - 1, truncated over the key's range) and ``restored``."""
    steps = (1 << bits) - 1
    w = Window.partitionBy(key)
    low, span = F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)
    level = F.when(span > 0, F.floor((F.col(value) - low) / span * steps)).otherwise(F.lit(0)).cast("long")
    return df.withColumn("level", level).withColumn("restored", F.when(span > 0, low + F.col("level") * span / steps).otherwise(low))


def sequence_status(frames: DataFrame, key: str = "sid", seq: str = "seq", order: str = "pos") -> DataFrame:
    """Add ``status``: ok, duplicate (not beyond the highest so far), gap (beyond its successor) or first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(seq).over(w)
    status = F.when(top.isNull(), "first").when(F.col(seq) <= top, "duplicate").when(F.col(seq) > top + 1, "gap").otherwise("ok")
    return frames.withColumn("status", status)


def pending_acks(frames: DataFrame, acks: DataFrame, key: str = "sid", seq: str = "seq") -> DataFrame:
    """(key, seq) in (last acknowledged, last seen] of each stream."""
    seen = frames.groupBy(key).agg(F.max(seq).alias("_last"))
    done = acks.groupBy(key).agg(F.max(seq).alias("_acked"))
    open_ = seen.join(done, key, "left").withColumn("_acked", F.coalesce("_acked", F.lit(-1)))
    return open_.where("_last > _acked").select(key, F.explode(F.sequence(F.col("_acked") + 1, F.col("_last"))).alias(seq))


def latest_state(log: DataFrame, key: str, order: str, op: str, columns: list[str]) -> DataFrame:
    """Last value of each column by key since the key's last delete; keys whose last event is a delete are gone.

    A null value leaves the earlier one: properties are merged one by one.
    """
    last = log.groupBy(key).agg(F.max(F.when(F.col(op) == "delete", F.col(order))).alias("_gone"))
    alive = log.join(last, key).where((F.col(op) != "delete") & (F.col("_gone").isNull() | (F.col(order) > F.col("_gone"))))
    return alive.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def assert_retract(log: DataFrame, columns: list[str], order: str, op: str) -> DataFrame:
    """The set of rows whose last event is not a delete: assertion and retraction of facts."""
    last = log.groupBy(*columns).agg(F.max_by(op, order).alias("_op"))
    return last.where("_op <> 'delete'").select(*columns)


def loader_stats(log: DataFrame, kind: str, op: str) -> DataFrame:
    """(kind, writes, deletes) of a change log."""
    deleted = F.col(op) == "delete"
    return log.groupBy(F.col(kind).alias("kind")).agg(F.count_if(~deleted).alias("writes"), F.count_if(deleted).alias("deletes"))


def prefix_split(df: DataFrame, order: str, train: float, validate: float) -> DataFrame:
    """Add ``split``: prefix cuts in the given order at floor(n * ratio)."""
    n = df.count()
    edge = int(n * train + 1e-9), int(n * train + 1e-9) + int(n * validate + 1e-9)
    parts = max(1, n // 100_000)
    w = Window.partitionBy("_part").orderBy(order)
    if parts > 1:  # ranges of about equal size, each ranked on its own
        shares = ", ".join(str((i + 1) / parts) for i in range(parts - 1))
        bounds = df.agg(F.expr(f"percentile_approx({order}, array({shares}))").alias("_bounds"))
        cut = df.join(F.broadcast(bounds)).withColumn("_part", F.expr(f"size(filter(_bounds, x -> x < {order}))")).drop("_bounds")
    else:
        cut = df.withColumn("_part", F.lit(0))
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    placed = cut.withColumn("_row", F.row_number().over(w)).join(base, "_part").withColumn("_row", F.col("_row") + F.col("_base"))
    return placed.withColumn("split", F.when(F.col("_row") <= edge[0], "train").when(F.col("_row") <= edge[1], "validation").otherwise("test")).drop("_part", "_row", "_base")
