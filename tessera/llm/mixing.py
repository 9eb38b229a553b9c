"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its rows.  Each document's
count is the Poisson quantile of a uniform number that is hashed from a seed and the document, so
the same document gets the same count on any cluster.  Documents are exploded by their counts and
shuffled globally by a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, packed, text_of
from tessera.llm.sharding import seeded_hex

#: Hex digits of the hash that make the uniform number; 52 bits fit a double exactly.
_DIGITS = 13
#: Standard deviations above the mean at which the quantile table ends.
_TAIL = 12


def source_rates(
    docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, temperature: float = 0.5, source: str = "source"
) -> DataFrame:
    """(stratum, rate, cdf): the mean repetition rate of each source and its Poisson quantile table.

    ``weights`` gives target weights by source name, any scale; a source without one gets 0.  Without
    ``weights`` the target is the size to the power ``temperature``.  ``total`` is the expected number
    of output rows, by default the number of input rows.  A null source counts as one source named "".
    The table has a row for each source and reaches ``_TAIL`` deviations above the mean.
    """
    stratum = F.coalesce(F.col(source).cast("string"), F.lit("")).alias("stratum")
    sizes = docs.groupBy(stratum).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(float(temperature))))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        given = F.create_map(*pairs)[F.col("stratum")] if pairs else F.lit(None).cast("double")
        sizes = sizes.withColumn("weight", F.coalesce(given, F.lit(0.0)))
    everything = Window.partitionBy()  # a row for each source meets here
    all_weight = F.sum("weight").over(everything)
    wanted = F.sum("rows").over(everything).cast("double") if total is None else F.lit(float(total))
    rate = F.when(all_weight > 0, wanted * F.col("weight") / all_weight / F.col("rows")).otherwise(0.0)
    rated = sizes.withColumn("rate", rate)
    # the log of k! keeps the table in range for any rate
    last = F.ceil(F.col("rate") + _TAIL * F.sqrt(F.col("rate")) + _TAIL).cast("int")
    terms = rated.select("stratum", "rate", F.posexplode(F.sequence(F.lit(0), last)).alias("k", "_k"))
    in_order = Window.partitionBy("stratum").orderBy("k")  # one running sum for the factorials, one for the masses
    logs = F.col("k") * F.ln(F.greatest(F.col("rate"), F.lit(1e-300))) - F.sum(F.ln(F.greatest(F.col("k"), F.lit(1)))).over(in_order)
    terms = terms.withColumn("mass", F.exp(logs - F.col("rate"))).withColumn("through", F.sum("mass").over(in_order))
    tables = terms.groupBy("stratum", "rate").agg(F.sort_array(F.collect_list(F.struct("k", "through"))).alias("m"))
    return tables.select("stratum", "rate", F.transform("m", lambda x: x["through"]).alias("cdf"))


def poisson_mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: float | None = None,
    temperature: float = 0.5,
    seed: int = 29,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """The mixture: rows of ``docs`` repeated, with ``rate``, ``copies``, ``copy`` (from 0) and ``shuffle``.

    Rows are dealt out by range of ``shuffle`` and sorted by it within partitions: reading the
    partitions in turn is one global random order.  A null doc_id is hashed by its text, so rows without
    an id and with equal texts get equal counts, as do repeated rows.  Texts of any length go along whole.  Columns of
    ``docs`` with the names of the results are replaced.  An empty table gives an empty table.
    """
    docs = fresh(docs, "rate", "copies", "copy", "shuffle")
    rates = source_rates(docs, weights, total, temperature, source)
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), text_of(text)))
    rows = packed(docs, stratum=F.coalesce(F.col(source).cast("string"), F.lit("")), key=F.md5(key.cast("binary")))
    uniform = F.conv(F.substring(seeded_hex(seed, F.col("key")), 1, _DIGITS), 16, 10).cast("long") / F.lit(float(16**_DIGITS))
    counted = (
        rows.withColumn("uniform", uniform)
        .join(rates, "stratum")
        .withColumn("copies", F.expr("size(filter(cdf, c -> c <= uniform))").cast("int"))
        .where("copies > 0")
        .select("row", "key", "rate", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        .withColumn("shuffle", seeded_hex(seed + 1, F.concat_ws(":", F.col("key"), F.col("copy").cast("string"))))
    )
    return counted.repartitionByRange("shuffle").sortWithinPartitions("shuffle").select("row.*", "rate", "copies", "copy", "shuffle")
