"""Helpers shared by the training-data operators: shared tables, code shipping, spread ranks."""

from __future__ import annotations

import ctypes
import io
import os
import sys
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one bucket of a distributed rank should hold.
ROWS_PER_BUCKET = 20_000

#: Rows that go to Python at a time.
ROWS_PER_BATCH = 2000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: The ASCII white space class ``[\x20\x09-\x0D]`` of the contracts.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; a local one only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("tessera.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("tessera.shared.dir", found)
    return found


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The table survives the loss of executors and is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the operators that run Python.

    Where the session has Spark's default of 10,000 rows a batch, it is lowered to ``ROWS_PER_BATCH``: both sides of the
    pipe to Python hold a whole batch of texts.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH_ROWS, "10000") == "10000":
        spark.conf.set(_BATCH_ROWS, str(ROWS_PER_BATCH))
    if getattr(context, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera_code.zip")
    with open(target, "wb") as out:
        out.write(held.getvalue())
    context.addPyFile(target)
    context._tessera_shipped = True


def text_slices(batch: pa.RecordBatch, column: int, limit: int = 1_000_000):
    """Consecutive slices of a batch of about ``limit`` bytes of text, one row at least, each with its texts as bytes (null: none).

    Only one slice's texts exist as Python objects at a time, whatever the batch holds.
    """
    held = batch.column(column)
    through = np.cumsum(pc.fill_null(pc.binary_length(held), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = int(through[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(through, before + limit, side="right")))
        part = batch.slice(begin, stop - begin)
        yield part, [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]
        begin = stop


def tidy(process, keeps_tokens: bool = False):
    """A function of Arrow batches that gives its memory back to the system when its task ends: workers are reused.

    The caches of token ids that an earlier task left in the worker go first, but for operators that use them.
    """

    def run(batches):
        tokens = sys.modules.get("tessera.llm.tokens")
        if tokens is not None and not keeps_tokens:
            tokens.forget()
        try:
            yield from process(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc32_text(column: str = "text") -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes of a text, null as empty."""
    return F.crc32(text_of(column).cast("binary")).cast("long")


def without_spaces(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns named like those an operator is about to add: the operator's win."""
    clashing = {name.lower() for name in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clashing])


def packed(df: DataFrame, **derived: Column) -> DataFrame:
    """Rows as one struct column ``row`` beside derived columns, so that no input name can clash."""
    fields = [F.col(f"`{c}`") for c in df.columns]
    return df.select(F.struct(*fields).alias("row"), *[v.alias(k) for k, v in derived.items()])


def buckets_for(n_rows: int) -> int:
    """How many buckets spread ``n_rows`` rows; it follows the input."""
    return max(1, -(-n_rows // ROWS_PER_BUCKET))


def spread_rank(df: DataFrame, group: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """0-based rank of each row within its group, without one task per group.

    ``bucket`` must grow with ``order``: rows are ranked within (group, bucket), and prefix sums
    over the buckets' counts give each bucket's first rank.  Only counts meet in one task.
    The columns of ``group`` and ``bucket`` must not be null.
    """
    keys = [*group, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = df.withColumn("_within", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return (
        within.join(starts, keys)
        .withColumn(name, F.col("_start") + F.col("_within") - 1)
        .drop("_start", "_within")
    )
