"""Tables of names: dictionaries, schema contexts, base values, and handlers of frames by kind."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import ranked


def dictionary(spark: SparkSession, words: list[str]) -> DataFrame:
    """(word, slot): a fixed vocabulary in the order given, each word once."""
    return spark.createDataFrame([(w, i) for i, w in enumerate(dict.fromkeys(words))], "word string, slot long")


def dictionary_of(df: DataFrame, column: str, order: str) -> DataFrame:
    """(word, slot): the values of a column by first use.

    Slots are prefix sums over ranges of first use: a row for each range meets in one place, the words do not.
    """
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("word")).agg(F.min(order).alias("_first"))
    return ranked(first, ["_first", "word"], "slot").select("word", "slot")


def encoded_words(df: DataFrame, column: str, words: DataFrame, name: str = "slot") -> DataFrame:
    """Add the slot of a column's value in a dictionary; -1 for a value that it does not hold, null for null."""
    known = words.select(F.col("word").alias("_word"), F.col("slot").alias("_slot"))
    joined = df.join(known, F.col(column) == F.col("_word"), "left")
    return joined.withColumn(name, F.when(F.col(column).isNotNull(), F.coalesce("_slot", F.lit(-1)))).drop("_word", "_slot")


def decoded_words(df: DataFrame, column: str, words: DataFrame, name: str = "word") -> DataFrame:
    """Add the word of a slot; empty for one that the dictionary does not hold."""
    known = words.select(F.col("word").alias("_word"), F.col("slot").alias("_slot"))
    return df.join(known, F.col(column) == F.col("_slot"), "left").withColumn(name, F.coalesce("_word", F.lit(""))).drop("_word", "_slot")


def merged_dictionaries(first: DataFrame, second: DataFrame) -> DataFrame:
    """(word, slot): the first dictionary, and after it the words that only the second has, in its order."""
    new = second.join(first.select("word"), "word", "left_anti")
    size = first.agg(F.coalesce(F.max("slot") + 1, F.lit(0)).alias("_size"))
    rank = F.row_number().over(Window.orderBy("slot")) - 1  # a dictionary is small by its kind: 65,536 words at most
    return first.unionByName(new.crossJoin(F.broadcast(size)).select("word", (F.col("_size") + rank).cast("long").alias("slot")))


def scoped_pool_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(role, requests, distinct, hits): interning of each column in a pool of its own."""
    long_ = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("role"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    sizes = long_.where("value is not null").groupBy("role", "value").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("role").agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("distinct"), (F.sum("n") - F.count(F.lit(1))).alias("hits"))


# --- schema contexts ---


def context_id(keys: Column) -> Column:
    """Identity of an array of keys: base32 of the first five bytes of the SHA-256 of the keys, parted by NUL."""
    digest = F.sha2(F.array_join(keys, "\0").cast("binary"), 256)
    bits = F.lpad(F.conv(F.substring(digest, 1, 10), 16, 2), 40, "0")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    at = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(bits.substr(k * 5 + 1, F.lit(5)), 2, 10).cast("int"))
    return F.array_join(F.transform(at, lambda k: F.lit(letters).substr(k + 1, F.lit(1))), "")


def context_id_of(keys: list[str]) -> str:
    """The identity of a list of keys."""
    return base64.b32encode(hashlib.sha256("\0".join(keys).encode()).digest()[:5]).decode().rstrip("=")


def schema_line(identity: Column, keys: Column, inline: bool = True) -> Column:
    """``@schema#id @keys=[..]``, or ``@schema#id`` alone."""
    head = F.concat(F.lit("@schema#"), identity)
    return F.concat(head, F.lit(" @keys=["), F.array_join(keys, " "), F.lit("]")) if inline else head


def schema_line_fields(line: Column) -> Column:
    """struct<id,keys> of a schema line; keys are null where it names none, the whole is null for any other line."""
    keys = F.regexp_extract(line, r"@keys=\[([^\]]*)\]", 1)
    listed = F.when(line.contains("@keys=["), F.filter(F.split(keys, r"\s+"), lambda k: k != ""))
    return F.when(line.rlike(r"^\s*@schema#\S+"), F.struct(F.regexp_extract(line, r"@schema#(\S+)", 1).alias("id"), listed.alias("keys")))


def numeric_key(key: Column) -> Column:
    """The number of a key ``#n``; null for any other key."""
    return F.when(key.rlike(r"^#\d+$"), F.substring(key, 2, 18).cast("long"))


def resolve_numeric_keys(df: DataFrame, key: str, context: str, contexts: DataFrame) -> DataFrame:
    """Add ``name``: a key ``#n`` as the n-th key of its context (id, keys), any other key as it is; null where the context lacks it."""
    known = contexts.select(F.col("id").alias("_id"), F.col("keys").alias("_keys"))
    joined = df.join(known, F.col(context) == F.col("_id"), "left")
    n = numeric_key(F.col(key))
    return joined.withColumn("name", F.when(n.isNull(), F.col(key)).otherwise(F.get("_keys", n.cast("int")))).drop("_id", "_keys")


def latest_contexts(definitions: DataFrame, order: str, limit: int) -> DataFrame:
    """(id, keys): the ``limit`` contexts that were defined last; one defined again counts by its last time."""
    last = definitions.groupBy("id").agg(F.max(order).alias("_at"), F.max_by("keys", order).alias("keys"))
    return last.orderBy(F.desc("_at"), "id").limit(limit).select("id", "keys")


# --- base values ---


def resident(uses: DataFrame, key: str, order: str, op: str, capacity: int) -> DataFrame:
    """(key, last_use): what a store of ``capacity`` holds after ``store``, ``touch`` and ``evict`` operations.

    The most recently used stay; a use after an eviction counts anew, and one that was never stored is none.
    """
    last = uses.groupBy(key).agg(
        F.max(F.when(F.col(op) == "store", F.col(order))).alias("_stored"),
        F.max(F.when(F.col(op) != "evict", F.col(order))).alias("last_use"),
        F.max(F.when(F.col(op) == "evict", F.col(order))).alias("_gone"),
    )
    alive = last.where(F.col("_stored").isNotNull() & (F.col("_gone").isNull() | (F.col("_stored") > F.col("_gone"))))
    return alive.orderBy(F.desc("last_use"), key).limit(capacity).select(key, "last_use")


def by_kind(frames: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], kind: str = "kind") -> DataFrame:
    """The union of what each kind's handler makes of its frames; frames of a kind without one are left out."""
    parts = [handle(frames.where(F.col(kind) == name)) for name, handle in handlers.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
