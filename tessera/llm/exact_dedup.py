"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass one hashes every normalised text and keeps the filter slots that two or more rows touch.
Pass two probes that filter: a row with an untouched slot is certainly unique and passes straight
through; only the rest shuffle, by a SHA-256 of the normalised text, and are compared exactly.

The filter has 16 bits a row and at most ``MAX_BITS`` bits, whatever the corpus holds: 2^20 words, some 100 MB
as rows in memory, are broadcast at most.  Beyond that more unique rows shuffle; results never change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, packed, text_of, without_spaces

#: Bits of filter for each row, and the bound on the whole filter that is broadcast.
BITS_PER_ROW = 16
MAX_BITS = 1 << 26
MIN_BITS = 1 << 15


def filter_bits(n_rows: int) -> int:
    """Size of the filter in bits, a power of two."""
    bits = MIN_BITS
    while bits < n_rows * BITS_PER_ROW and bits < MAX_BITS:
        bits *= 2
    return bits


def _slots(fingerprint: Column, bits: int) -> list[Column]:
    """The two slots of a 64-bit fingerprint."""
    return [F.pmod(fingerprint, F.lit(bits)), F.pmod(F.xxhash64(fingerprint, F.lit(7)), F.lit(bits))]


def _word(slot: Column) -> Column:
    return F.shiftright(slot, 6)


def _bit(slot: Column) -> Column:
    return slot.bitwiseAND(F.lit(63)).cast("int")


def slot_filter(fingerprints: DataFrame, column: str, bits: int, at_least: int) -> DataFrame:
    """Bloom filter as (word, bits): slots that ``at_least`` rows touch, in 64-bit words.

    At most ``bits / 64`` rows.  Counts are summed before the shuffle, so a hot text costs one row
    for each task.
    """
    slots = fingerprints.select(F.explode(F.array(*_slots(F.col(column), bits))).alias("slot"))
    touched = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    return touched.groupBy(_word(F.col("slot")).alias("word")).agg(F.bit_or(one).alias("bits"))


def with_membership(df: DataFrame, column: str, words: DataFrame, bits: int, name: str) -> DataFrame:
    """Add boolean ``name``: may the 64-bit ``column`` be in the filter?  A broadcast of ``bits / 8`` bytes."""
    for k, slot in enumerate(_slots(F.col(column), bits)):
        held = F.broadcast(words.select(F.col("word").alias(f"_word{k}"), F.col("bits").alias(f"_bits{k}")))
        df = df.withColumn(f"_slot{k}", slot)
        df = df.join(held, _word(F.col(f"_slot{k}")) == F.col(f"_word{k}"), "left")
    hit = [F.expr(f"coalesce(getbit(_bits{k}, cast(_slot{k} & 63 as int)), 0) = 1") for k in (0, 1)]
    return df.withColumn(name, hit[0] & hit[1]).drop(*[f"_{x}{k}" for x in ("word", "bits", "slot") for k in (0, 1)])


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``; null counts as
    empty, and all empty texts are equal.  Of equal texts the row with the most code points in the
    original text stays, then the smallest doc_id (a null doc_id comes last).  Of rows that agree in
    text and doc_id exactly one stays.  Columns of ``docs`` that have the names of the results are
    replaced by them.  Texts of any length are compared whole, by their SHA-256.  An empty table gives an empty table.
    """
    docs = fresh(docs, "keep_id", "group_size", "kept", "text_sha256")
    n_rows = docs.count()
    bits = filter_bits(n_rows)
    plain = without_spaces(text_of(text))
    repeated = slot_filter(docs.select(F.xxhash64(plain).alias("h")), "h", bits, 2)

    rows = packed(docs, h=F.xxhash64(plain), sha=F.sha2(plain.cast("binary"), 256), id=F.col(doc_id), chars=F.length(text_of(text)))
    rows = with_membership(rows, "h", repeated, bits, "maybe")

    unique = rows.where(~F.col("maybe")).select(
        "row.*",
        F.col("id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    maybe = rows.where("maybe").select("row", "sha", "id", "chars")
    order = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))
    groups = maybe.groupBy(F.col("sha").alias("group_sha")).agg(
        F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best")
    )
    same = Window.partitionBy("sha", "chars", "id").orderBy(F.lit(1))
    copy_number = maybe.withColumn("copy", F.row_number().over(same))
    judged = copy_number.join(groups, F.col("sha") == F.col("group_sha")).select(
        "row.*",
        F.col("best.id").alias("keep_id"),
        F.col("group_size"),
        ((order == F.col("best")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return unique.unionByName(judged)
