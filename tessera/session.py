"""Session defaults and table loading shared by all queries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit a test on one machine; a cluster session brings its own.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and ``bench.py``."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessera")
    builder = builder.config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
    for key, value in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over four slices a core: for much work on few bytes, where a file or two would be one task's."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
