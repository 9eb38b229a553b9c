"""Text economy: string pools, interning, key dictionaries, token estimates and text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import ranked


def estimated_tokens(text: Column) -> Column:
    """(bytes + 3) / 4 in whole numbers."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def string_pool(strings: DataFrame, column: str, min_bytes: int = 20, min_count: int = 2, limit: int = 256) -> DataFrame:
    """(value, n, slot): strings worth pooling, most frequent first, then longest, then by value."""
    counts = strings.where(F.octet_length(column) >= min_bytes).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    best = counts.orderBy(F.desc("n"), F.desc(F.octet_length("value")), "value").limit(limit)
    slot = F.row_number().over(Window.orderBy(F.desc("n"), F.desc(F.octet_length("value")), "value")) - 1
    return best.withColumn("slot", slot.cast("long"))


def interned(df: DataFrame, column: str, order: str, min_bytes: int = 50, pool_size: int = 256) -> DataFrame:
    """Add ``pool`` and ``slot`` of the second and later occurrences of long strings; nulls where the text stands itself."""
    long_ = df.where(F.octet_length(column) >= min_bytes).groupBy(F.col(column).alias("_v")).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    joined = df.join(ranked(long_, ["_first", "_v"], "_rank"), F.col(column) == F.col("_v"), "left")
    later = F.col(order) > F.col("_first")
    return joined.withColumns({"pool": F.when(later, F.floor(F.col("_rank") / pool_size)).cast("long"), "slot": F.when(later, F.col("_rank") % pool_size).cast("long")}).drop("_v", "_first", "_n", "_rank")


def pool_stats(strings: DataFrame, column: str) -> DataFrame:
    """One row: requests, distinct strings, hits, and the hit rate."""
    s = strings.agg(F.count(column).alias("requests"), F.countDistinct(column).alias("misses"))
    hits = F.col("requests") - F.col("misses")
    return s.select("requests", "misses", hits.alias("hits"), F.when(F.col("requests") > 0, hits / F.col("requests")).otherwise(0.0).alias("hit_rate"))


def key_dictionary(keys: DataFrame, key: str, order: str, learn: int | None = None) -> DataFrame:
    """(key, slot, uses): keys in order of first use; with ``learn`` only those first used in the first frames."""
    found = keys.groupBy(F.col(key).alias("key")).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("uses"))
    if learn is not None:
        found = found.where(F.col("_first") < learn)
    return ranked(found, ["_first", "key"], "slot").select("key", "slot", "uses")


def tabular_lines(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, text): the rows of each key as a text table with a header and ``@end``; cells are parted by ``|``.

    Null cells are ``_``; bars and backslashes in cells are escaped.  A key's rows meet in one place, as the
    text does.
    """
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"([|\\])", r"\\$1"), F.lit("_")) for c in columns]
    line = F.concat(F.lit("|"), F.concat_ws("|", *cells), F.lit("|"))
    rows = df.select(key, F.struct(F.col(order).alias("o"), line.alias("line")).alias("r"))
    table = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list("r")).alias("_r"))
    # fixed value: the header of a table
    head = F.concat(F.lit("@tab _ rows="), F.col("_n").cast("string"), F.lit(f" cols={len(columns)} [{' '.join(columns)}]"))
    body = F.array_join(F.transform("_r", lambda x: x["line"]), "\n")
    return table.select(key, F.concat_ws("\n", head, body, F.lit("@end")).alias("text"))


def is_tabular(df: DataFrame, key: str, fields: str, max_columns: int = 64, min_rows: int = 3) -> DataFrame:
    """(key, n_rows, n_common, n_union, tabular) from rows with an array of field names: is a list of records a table?"""
    seen = df.select(key, F.explode(F.array_distinct(fields)).alias("f")).groupBy(key, "f").agg(F.count(F.lit(1)).alias("n"))
    rows = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.size(fields)).alias("_least"))
    both = rows.join(seen, key, "left").groupBy(key, "n_rows", "_least").agg(F.count_if(F.col("n") == F.col("n_rows")).alias("n_common"), F.count("f").alias("n_union"))
    good = (F.col("n_rows") >= min_rows) & (F.col("_least") > 0) & (F.col("n_union") <= max_columns) & (2 * F.col("n_common") >= F.col("n_union"))
    return both.select(key, "n_rows", "n_common", "n_union", good.alias("tabular"))


def sanitised_label(label: Column) -> Column:
    """A relationship name: other characters than letters, digits and _ become _, a leading digit gets one."""
    plain = F.regexp_replace(label, "[^A-Za-z0-9_]", "_")
    return F.when(plain == "", "UNKNOWN").when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain)


def relation_of(predicate: Column) -> Column:
    """The name after the last ``#`` or ``/`` of an IRI, as a relationship name."""
    return sanitised_label(F.regexp_extract(predicate, r"([^/#]*)$", 1))
