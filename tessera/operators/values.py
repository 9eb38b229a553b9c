"""Nested values: typed access to JSON text, inference, shapes and drift, column statistics, content ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds that :func:`typed_field` reads, and the variant types that count as an exact match.
EXACT = {"bigint": ("BIGINT",), "double": ("DOUBLE", "FLOAT", "DECIMAL"), "string": ("STRING",), "boolean": ("BOOLEAN",)}


def typed_field(json: Column, path: str, kind: str) -> tuple[Column, Column]:
    """(value, valid) of a path in JSON text; a missing field, null or another type is not valid and has no value."""
    held = F.try_variant_get(F.try_parse_json(json), path, "variant")
    shape = F.schema_of_variant(held)
    valid = F.coalesce(F.exists(F.array(*[F.lit(k) for k in EXACT[kind]]), lambda k: shape.startswith(k)), F.lit(False))
    return F.when(valid, F.try_variant_get(held, "$", kind)), valid


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n_rows, n_valid, n_null) of columns, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', n, `{c}`, n - `{c}`" for c in columns)
    return counts.select(F.expr(f"stack({len(columns)}, {pairs}) as (field, n_rows, n_valid, n_null)"))


# Patterns of texts that stand for another type.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def enriched_kind(name: str, text: Column) -> Column:
    """What a text field is read as: datetime, bytes, uuid or string, by its name first and its form then."""
    low = name.lower()
    # fixed values: names that say what a field holds
    timely = "time" in low or "date" in low or low.endswith("_at") or low in ("created", "updated")
    binary = any(x in low for x in ("data", "content", "payload", "blob"))
    is_time = text.rlike(ISO_TIME) & F.try_to_timestamp(text).isNotNull()
    kind = F.when(is_time, "datetime").when(text.rlike(UUID), "uuid").otherwise("string")
    if binary:
        kind = F.when(F.try_to_binary(text, F.lit("base64")).isNotNull(), "bytes").otherwise(kind)
    return F.when(is_time, "datetime").otherwise(kind) if timely else kind


def shape(json: Column) -> Column:
    """The shape of JSON text: names in order and types, the same for values of one schema."""
    return F.schema_of_variant(F.try_parse_json(json))


def drift(df: DataFrame, json: str) -> DataFrame:
    """(shape, n): how many rows have each shape; more than one row is drift."""
    return df.groupBy(shape(F.col(json)).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def content_id(content: Column) -> Column:
    """``sha256:`` and the hex digest of a text or binary, the id of a blob."""
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def blob_store(df: DataFrame, content: str) -> DataFrame:
    """(cid, size): the distinct blobs of a column; putting one twice changes nothing."""
    return df.select(content_id(F.col(content)).alias("cid"), F.octet_length(content).cast("long").alias("size")).dropDuplicates(["cid"])


def fnv1a_64(parts: list[int | bytes]) -> int:
    """64-bit FNV-1a over bytes."""
    value = 0xCBF29CE484222325
    for part in parts:
        for byte in bytes([part]) if isinstance(part, int) else part:
            value = (value ^ byte) * 0x100000001B3 % (1 << 64)
    return value
