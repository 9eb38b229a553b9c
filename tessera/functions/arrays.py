"""Typed arrays and values: tensors as columns, group varints, typed getters, and changes to nested JSON."""

from __future__ import annotations

import base64
import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.sources import wire
from tessera.sources.wire import Tensor, WireError, varint

# Numbers of the element types of tensors, and the tag of group-varint arrays.
DTYPES = {1: "<f4", 2: "<f2", 4: "i1", 5: "<i2", 6: "<i4", 7: "<i8", 8: "u1", 9: "<u2", 10: "<u4", 11: "<u8", 12: "<f8", 13: "?"}
GROUP_VARINT = 0x0F
#: Whole numbers beyond this lose digits in 32-bit floats.
EXACT_FLOAT = 1 << 24


def tensor_of(values, dtype: int = 1, dims: tuple[int, ...] | None = None) -> Tensor:
    """Numbers as a tensor of an element type."""
    data = np.asarray(values, dtype=DTYPES[dtype])
    return Tensor(dtype, dims or data.shape, data.tobytes())


def view(t: Tensor, dtype: int) -> np.ndarray | None:
    """The elements of a tensor without a copy; None where it holds another type or a wrong number of bytes."""
    kind = np.dtype(DTYPES.get(dtype, "u1"))
    if t.dtype != dtype or len(t.data) != kind.itemsize * int(np.prod(t.dims, dtype=np.int64)):
        return None
    return np.frombuffer(t.data, kind)


def auto_tensor(values: list, precise: bool = False) -> Tensor | None:
    """A list of numbers as a tensor: whole numbers as int64, others as float32, or float64 where ``precise``; else None."""
    if not values or not all(type(x) in (int, float) for x in values):
        return None
    if all(type(x) is int for x in values):
        return tensor_of(values, 7) if all(-(1 << 63) <= x < 1 << 63 for x in values) else None
    return tensor_of(values, 12 if precise else 1)


def group_varint(values: list[int]) -> bytes:
    """Signed 32-bit integers, zigzagged, in groups of four after a control byte with their sizes."""
    coded = (np.asarray(values, dtype=np.int64) << 1) ^ (np.asarray(values, dtype=np.int64) >> 63)
    out = bytearray([GROUP_VARINT]) + varint(len(values))
    for at in range(0, len(coded), 4):
        four = [*coded[at : at + 4].tolist(), 0, 0, 0][:4]
        sizes = [max(1, -(-x.bit_length() // 8)) for x in four]
        out.append(sum((n - 1) << 2 * k for k, n in enumerate(sizes)))
        for x, n in zip(four, sizes, strict=True):
            out += x.to_bytes(n, "little")
    return bytes(out)


def of_group_varint(data: bytes) -> list[int]:
    """The integers of :func:`group_varint`."""
    d = wire.Decoder(data, wire.Limits(), None)
    if d.take(1)[0] != GROUP_VARINT:
        raise WireError("ERR_INVALID_TAG")
    n, out = d.count(), []
    while len(out) < n:
        control = d.take(1)[0]
        for k in range(4):
            x = int.from_bytes(d.take((control >> 2 * k & 3) + 1), "little")
            out.append(x >> 1 if x & 1 == 0 else -(x >> 1) - 1)
    return out[:n]


# --- columns ---


def tensor_bytes(values: str | Column, code: str = "f") -> Column:
    """Arrays of numbers as little-endian bytes (f float32, d float64, i int32, q int64)."""

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else np.asarray(v, dtype="<" + {"f": "f4", "d": "f8", "i": "i4", "q": "i8"}[code]).tobytes())

    return F.pandas_udf(run, "binary")(values)


def tensor_values(data: str | Column, code: str = "f", width: int | None = None) -> Column:
    """Little-endian bytes as an array of doubles or longs; null where they are not ``width`` whole elements."""
    kind = np.dtype("<" + {"f": "f4", "d": "f8", "i": "i4", "q": "i8"}[code])
    result = "array<double>" if code in "fd" else "array<long>"

    def one(b):
        if b is None or len(b) % kind.itemsize or (width is not None and len(b) != width * kind.itemsize):
            return None
        return np.frombuffer(b, kind).astype("f8" if code in "fd" else "i8")

    def run(column: pd.Series) -> pd.Series:
        return column.map(one)

    return F.pandas_udf(run, result)(data)


def tensor_column(document: str | Column, field: str) -> Column:
    """The tensor under a field of documents as an array of doubles, short rows null; its shape comes from the column's hint where there is one."""

    def one(b):
        try:
            value = wire.decode(bytes(b))
            hint = next((h for h in wire.hints_of(bytes(b)) if h.field == field), None)
        except (WireError, TypeError):
            return None
        t = value.get(field) if isinstance(value, dict) else None
        if isinstance(t, list) and all(type(x) in (int, float) for x in t):
            t = tensor_of([float(x) for x in t], 12)
        found = view(t, t.dtype) if isinstance(t, Tensor) and t.dtype in (1, 12) else None
        if found is None or (hint is not None and hint.shape and len(found) != int(np.prod(hint.shape))):
            return None
        return found.astype("f8")

    def run(column: pd.Series) -> pd.Series:
        return column.map(one)

    return F.pandas_udf(run, "array<double>")(document)


def hinted_documents(text: str | Column, hints: tuple[wire.Hint, ...], tensors: tuple[str, ...] = ()) -> Column:
    """JSON objects as documents with column hints; the number lists under ``tensors`` become tensors."""

    def one(t):
        if t is None:
            return None
        value = wire.from_json(t)
        for name in tensors:
            if (found := auto_tensor([float(x) for x in value.get(name, [])])) is not None:
                value[name] = found
        return wire.encode(value, hints=hints)

    def run(column: pd.Series) -> pd.Series:
        return column.map(one)

    return F.pandas_udf(run, "binary")(text)


def document_info(document: str | Column) -> Column:
    """struct<fields,n_rows,hints>: dictionary, rows (-1 where the root is no array) and hinted columns of documents."""

    def one(b):
        try:
            value = wire.decode(bytes(b))
            hints = [{"field": h.field, "type": h.type, "shape": list(h.shape), "flags": h.flags, "total_bytes": h.total_bytes()} for h in wire.hints_of(bytes(b))]
            return wire.fields_of(bytes(b)), len(value) if isinstance(value, list) else -1, hints
        except (WireError, TypeError):
            return None, None, None

    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(b) for b in column], columns=["fields", "n_rows", "hints"])

    return F.pandas_udf(run, "struct<fields:array<string>,n_rows:int,hints:array<struct<field:string,type:int,shape:array<int>,flags:int,total_bytes:int>>>")(document)


def group_varint_bytes(values: str | Column) -> Column:
    """Arrays of 32-bit integers as group varints."""

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else group_varint(list(v)))

    return F.pandas_udf(run, "binary")(values)


def group_varint_values(data: str | Column) -> Column:
    """Group varints as arrays; null where the bytes are damaged."""

    def one(b):
        try:
            return None if b is None else of_group_varint(bytes(b))
        except WireError:
            return None

    def run(column: pd.Series) -> pd.Series:
        return column.map(one)

    return F.pandas_udf(run, "array<long>")(data)


def strings_at(text: Column, path: str) -> Column:
    """The array of strings at a path of JSON text: what is no string is left out, a missing path is an empty array."""
    items = F.from_json(F.get_json_object(text, path), "array<variant>")
    kept = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(kept, lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>"))


def floats_at(text: Column, path: str) -> Column:
    """The array of numbers at a path of JSON text as floats; empty where the path is missing or holds anything else."""
    return F.coalesce(F.from_json(F.get_json_object(text, path), "array<float>", {"mode": "PERMISSIVE"}), F.array().cast("array<float>"))


def string_at(text: Column, path: str) -> Column:
    """The string at a path of JSON text, empty where it is missing."""
    return F.coalesce(F.get_json_object(text, path), F.lit(""))


def with_member(text: Column, key: str, value: Column) -> Column:
    """JSON objects with a member set to a JSON text: the last one of its name, in its place or at the end."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, v in zip(a, b, strict=True):
            if x is None:
                out.append(None)
                continue
            held = json.loads(x)
            held[key] = None if v is None else json.loads(v)
            out.append(json.dumps(held, separators=(",", ":"), ensure_ascii=False))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(text, value)


def with_element(text: Column, value: Column) -> Column:
    """JSON arrays with one more element, a JSON text."""
    inner = F.regexp_replace(F.trim(text), r"\s*\]$", "")
    comma = F.when(inner.rlike(r"^\[\s*$"), "").otherwise(",")
    return F.when(F.trim(text).startswith("["), F.concat(inner, comma, F.coalesce(value, F.lit("null")), F.lit("]")))


def any_document(value: Column) -> Column:
    """Any column as documents: its JSON form, lists of numbers as tensors."""

    def one(t):
        if t is None:
            return None

        def walk(v):
            if isinstance(v, list):
                return auto_tensor(v) or [walk(x) for x in v]
            return {k: walk(x) for k, x in v.items()} if isinstance(v, dict) else v

        return wire.encode(walk(wire.from_json(t)))

    def run(column: pd.Series) -> pd.Series:
        return column.map(one)

    return F.pandas_udf(run, "binary")(F.to_json(value))


def any_json(document: str | Column) -> Column:
    """Documents as JSON text with tensors as lists of numbers."""

    def walk(v):
        if isinstance(v, Tensor):
            found = view(v, v.dtype)
            return base64.b64encode(v.data).decode() if found is None else found.tolist()
        if isinstance(v, list):
            return [walk(x) for x in v]
        return {k: walk(x) for k, x in v.items()} if isinstance(v, dict) else wire.jsonable(v)

    def one(b):
        try:
            return None if b is None else json.dumps(walk(wire.decode(bytes(b))), separators=(",", ":"), ensure_ascii=False)
        except (WireError, struct.error):
            return None

    def run(column: pd.Series) -> pd.Series:
        return column.map(one)

    return F.pandas_udf(run, "string")(document)


def codec_for(content_type: Column) -> Column:
    """The codec that a content type asks for: text/json ones are json, any other binary one is the binary form; json where unsure."""
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return F.when(kind.rlike(r"(^|[/+])json$") | kind.isNull(), "json").when(kind.rlike(r"^application/(x-)?[a-z]+$") & (kind != "application/xml"), "binary").otherwise("json")


#: Functions by name that turn a decoded value into rows of a type.
_DECODERS: dict[str, object] = {}


def register_decoder(name: str, function) -> None:
    """Name a function of a decoded value; a later one of the same name takes its place."""
    _DECODERS[name] = function


def is_registered(name: str) -> bool:
    return name in _DECODERS


def unregister_decoder(name: str) -> None:
    _DECODERS.pop(name, None)


def decoded_by(name: str, document: str | Column, schema: str) -> Column:
    """Documents as values of a Spark type, by a registered function; null where the bytes are damaged."""
    function = _DECODERS[name]

    def one(b):
        try:
            return None if b is None else function(wire.decode(bytes(b)))
        except WireError:
            return None

    if schema.startswith("struct"):
        names = [f.split(":")[0] for f in schema[7:-1].split(",")]

        def rows(column: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([one(b) or dict.fromkeys(names) for b in column], columns=names)

        return F.pandas_udf(rows, schema)(document)

    def run(column: pd.Series) -> pd.Series:
        return column.map(one)

    return F.pandas_udf(run, schema)(document)
