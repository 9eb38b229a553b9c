"""Numeric array functions: sparse forms, half floats, byte shuffles and masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sparsity(df: DataFrame, column: str, zero: float = 0.0) -> DataFrame:
    """Add ``zeros`` (entries of magnitude below ``zero``, or 0), ``sparse`` (over 0.4 of 16 or more) and ``sparse_bytes``."""
    small = f"filter({column}, x -> {'x = 0' if zero == 0 else f'abs(x) < {zero}'})"
    zeros = F.expr(f"size({small})").cast("long")
    n = F.size(column).cast("long")
    return df.withColumns({"zeros": zeros, "sparse": (n >= 16) & (zeros > 0.4 * n), "sparse_bytes": 8 * (n - zeros) + 32})


def to_coo(df: DataFrame, key: str, column: str, zero: float = 0.0) -> DataFrame:
    """(key, slot, value) of the entries that are not zero."""
    rows = df.select(key, F.posexplode(column).alias("slot", "value")).withColumn("slot", F.col("slot").cast("long"))
    return rows.where(F.col("value") != 0 if zero == 0 else F.abs("value") >= zero)


def from_coo(df: DataFrame, key: str, size: int) -> DataFrame:
    """(key, values): dense arrays of ``size`` from (key, slot, value)."""
    held = df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m"))
    return held.select(key, F.expr(f"transform(sequence(0L, {size - 1}L), i -> coalesce(try_element_at(m, i), 0))").alias("values"))


def mask_members(mask: Column) -> Column:
    """Indices of the set bits of a binary mask, least significant bit first."""
    digits = F.hex(mask)
    value = lambda i: F.conv(F.substring(digits, 2 * F.floor(i / 8).cast("int") + 1, F.lit(2)), 16, 10).cast("int")
    every = F.sequence(F.lit(0), F.greatest(F.octet_length(mask) * 8 - 1, F.lit(0)))
    set_ = F.filter(every, lambda i: F.getbit(value(i), (i % 8).cast("int")) == 1)
    return F.when(F.octet_length(mask) > 0, set_).otherwise(F.array().cast("array<int>"))


def indices_to_mask(indices: Column, size: int) -> Column:
    """A mask of ``size`` bits as text of hex digits, indices out of range left out."""
    n = -(-size // 8)
    kept = F.filter(indices, lambda i: (i >= 0) & (i < size))
    byte = lambda k: F.aggregate(kept, F.lit(0), lambda s, i: F.when(F.floor(i / 8) == k, s.bitwiseOR(F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2.0), i % 8).cast("int"))).otherwise(s))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lpad(F.hex(byte(k)), 2, "0")), "")


def _halves(values: pd.Series) -> pd.Series:
    def one(v):
        bits = np.asarray(v, dtype="<f4").view("<u4")
        sign, exponent, mantissa = (bits >> 16) & 0x8000, ((bits >> 23) & 0xFF).astype(np.int64) - 112, (bits >> 13) & 0x3FF
        half = np.where(exponent <= 0, sign, np.where(exponent >= 31, sign | 0x7C00, sign | (np.clip(exponent, 0, 31).astype(np.uint32) << 10) | mantissa))
        return half.astype("<u2").tobytes()

    return values.map(lambda v: None if v is None else one(v))


def float16_bytes(column: str | Column) -> Column:
    """Float arrays as little-endian half floats: mantissas are cut off, subnormals become 0."""
    return F.pandas_udf(_halves, "binary")(column)


def _floats(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f2").astype(np.float32))


def float16_values(column: str | Column) -> Column:
    """Little-endian half floats as float arrays."""
    return F.pandas_udf(_floats, "array<float>")(column)


def _transposed(data: pd.Series, width: int, back: bool) -> pd.Series:
    def one(b):
        n = len(b) // width
        body = np.frombuffer(b[: n * width], dtype=np.uint8).reshape((width, n) if back else (n, width))
        return body.T.tobytes() + bytes(len(b) - n * width)

    return data.map(lambda b: None if b is None else one(b))


def byte_shuffled(column: str | Column, width: int) -> Column:
    """Bytes of elements of ``width`` grouped by their place; a remainder becomes zeros."""
    return _shuffle(column, width, False)


def byte_unshuffled(column: str | Column, width: int) -> Column:
    """The inverse of :func:`byte_shuffled` for whole elements."""
    return _shuffle(column, width, True)


def _shuffle(column: str | Column, width: int, back: bool) -> Column:
    def run(data: pd.Series) -> pd.Series:
        return _transposed(data, width, back)

    return F.pandas_udf(run, "binary")(column)
