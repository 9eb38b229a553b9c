"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the rank as a fraction of the
source's size orders all rows, and equal cuts of that order are the shards.  Any stretch of the
order holds each source in proportion, so every shard matches the mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import buckets_for, fresh, packed, spread_rank, text_of

#: Hex digits of the seeded MD5 that place a row in a bucket.
_DIGITS = 7


def seeded_hex(seed: int, value: Column) -> Column:
    """Seeded MD5 of a value as 32 hex digits: a shuffle order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), value).cast("binary"))


def stratified_shards(
    docs: DataFrame, n_shards: int, seed: int = 17, text: str = "text", doc_id: str = "doc_id", source: str = "source"
) -> DataFrame:
    """Every row of ``docs`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in its shard).

    Row counts of shards differ by one at most.  A null source is a stratum of its own.  A null
    doc_id is shuffled by its text; rows that agree in doc_id are ordered by text, and rows that agree in
    both are interchangeable.  Columns of ``docs`` named ``shard`` or ``slot`` are replaced.
    Texts of any length go along whole.  An empty table gives an empty table.  No source, however large, meets in one task.
    """
    docs = fresh(docs, "shard", "slot")
    totals = docs.agg(F.count(F.lit(1)).alias("n"), F.count(F.col(doc_id)).alias("ids")).first()
    n_rows = totals["n"]
    if n_rows == 0:
        return docs.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    n_buckets = buckets_for(n_rows)
    key = F.col(doc_id).cast("string")
    if totals["ids"] < n_rows:  # the text column is read for the order only where ids are missing
        key = F.coalesce(key, F.concat(F.lit("text:"), text_of(text)))
    stratum = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    rows = packed(docs, stratum=stratum, shuffle=seeded_hex(seed, key), tie=F.col(doc_id), body=F.xxhash64(text_of(text)))
    digits = F.conv(F.substring("shuffle", 1, _DIGITS), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(digits * n_buckets / F.lit(16**_DIGITS)).cast("long"))
    order = [F.col("shuffle"), F.col("tie"), F.col("body")]
    ranked = spread_rank(rows, ["stratum"], "bucket", order, "rank").drop("bucket", "body")

    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("stratum_rows"))
    placed = ranked.join(sizes, "stratum").withColumn("fraction", (F.col("rank") + 0.5) / F.col("stratum_rows"))
    placed = placed.withColumn("cut", F.floor(F.col("fraction") * n_buckets).cast("long"))
    by_fraction = [F.col("fraction"), F.col("stratum"), F.col("rank")]
    whole = spread_rank(placed, [], "cut", by_fraction, "position")

    small, wide = n_rows // n_shards, n_rows % n_shards  # the first `wide` shards hold one row more
    edge = wide * (small + 1)
    position = F.col("position")
    shard = F.when(position < edge, F.floor(position / (small + 1))).otherwise(wide + F.floor((position - edge) / max(small, 1)))
    shard = shard.cast("int")
    start = F.col("shard") * small + F.least(F.col("shard"), F.lit(wide))
    return whole.withColumn("shard", shard).withColumn("slot", (position - start).cast("long")).select("row.*", "shard", "slot")
