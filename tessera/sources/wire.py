"""Self-describing binary documents: both generations of the wire format, as columns and as files.

Files are read by Spark's ``binaryFile`` source, so any store that Spark reads will do; documents become
JSON text, which ``parse_json`` turns into VARIANT.  Values without a JSON form follow one rule each:
bytes are base64, times RFC 3339 with nanoseconds, integers beyond 2**53 text, decimals and UUIDs text,
tensors {"_type", "dtype", "dims", "data"}.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import json
import struct
import sys
import uuid
import zlib
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class WireError(ValueError):
    """Bytes that are no document, with a canonical code."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Limits:
    """Guard rails of decoding."""

    depth: int = 1000
    items: int = 1_000_000
    text: int = 10_000_000
    data: int = 50_000_000
    rank: int = 32
    decompressed: int = 256 << 20


@dataclass
class Tensor:
    """A typed array of little-endian bytes in row order."""

    dtype: int
    dims: tuple[int, ...]
    data: bytes


@dataclass
class Extension:
    """An unknown extension, kept as it came."""

    kind: int
    payload: bytes


@dataclass
class TensorRef:
    """A tensor kept elsewhere: a store and a key in it."""

    store: int
    key: bytes


@dataclass
class Media:
    """An image (format, width, height) or a sound (encoding, rate, channels) with its bytes."""

    kind: str
    about: tuple[int, int, int]
    data: bytes


@dataclass
class Adjacency:
    """Compressed rows of a graph; column indices are ``width`` bytes each."""

    width: int
    offsets: list[int]
    indices: bytes


@dataclass
class RichText:
    """Text with token ids and spans (start, end, kind)."""

    text: str
    tokens: list[int]
    spans: list[tuple[int, int, int]]


@dataclass
class Delta:
    """Changes to a base value: (op, field id, value), ops 1 set, 2 delete, 3 append."""

    base: int
    ops: list[tuple[int, int, object]]


@dataclass
class GraphNode:
    """A node with labels and properties."""

    id: str
    labels: list[str]
    props: dict


@dataclass
class GraphEdge:
    """An edge with a type and properties."""

    src: str
    dst: str
    type: str
    props: dict


@dataclass
class Shard:
    """Nodes, edges and metadata that stand for themselves; a batch of nodes or of edges is one without the rest."""

    nodes: list[GraphNode]
    edges: list[GraphEdge]
    meta: dict
    kind: str = "shard"


class Bitmask(list):
    """Booleans that are written one bit each, lowest first."""


@dataclass(frozen=True)
class Hint:
    """What a column is expected to hold: type, shape, flags (1 required, 2 columnar, 4 fixed size, 8 sorted)."""

    field: str
    type: int
    shape: tuple[int, ...] = ()
    flags: int = 0

    def total_bytes(self) -> int:
        """Bytes of one value, -1 where they vary."""
        size = HINT_BYTES.get(self.type, -1)
        for dim in self.shape if size > 0 else ():
            size *= dim
        return size


class Nanos(int):
    """Nanoseconds since 1970 in UTC."""


# Tags of the wire format.
NULL, FALSE, TRUE, INT, DOUBLE, TEXT, ARRAY, OBJECT, BYTES, UINT, DECIMAL, TIME, UUID_, BIGINT, EXT, FLOAT = range(16)
INTS, DOUBLES, FLOATS, TEXTS = 0x16, 0x17, 0x18, 0x19
TENSOR, TENSOR_REF, IMAGE, AUDIO, BITMASK = 0x20, 0x21, 0x22, 0x23, 0x24
ADJACENCY, RICH_TEXT, DELTA, NODE, EDGE, NODES, EDGES, SHARD = 0x30, 0x31, 0x32, 0x35, 0x36, 0x37, 0x38, 0x39
HAS_HINTS = 8
#: Bytes of the hinted types int64, float64, uint64, datetime, uuid and float32.
HINT_BYTES = {INT: 8, DOUBLE: 8, UINT: 8, TIME: 8, UUID_: 16, FLOAT: 4}
# Numbers of the types in a fingerprint, and of the elements of tensors.
TYPES = ("null", "bool", "int", "uint", "float", "decimal", "string", "bytes", "datetime", "uuid", "bigint", "array", "object", "tensor", "tensor_ref", "image", "audio", "adjacency", "rich_text", "delta", "node", "edge", "nodes", "edges", "shard", "bitmask", "ext")
FIXINT, FIXARRAY, FIXMAP, FIXNEG, RESERVED = 0x40, 0xC0, 0xD0, 0xE0, 0xF0
MAGIC = b"SJ\x02"
COMPRESS_FROM = 256


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> int:
    return n * 2 if n >= 0 else -n * 2 - 1


def _sized(data: bytes) -> bytes:
    return varint(len(data)) + data


class Encoder:
    """Values to bytes; ``keys`` collects the dictionary of the second generation, None means inline keys."""

    def __init__(self, keys: dict[str, int] | None, drop_nulls: bool = False, sort_keys: bool = False):
        self.keys, self.drop_nulls, self.sort_keys = keys, drop_nulls, sort_keys

    def _key(self, key: str) -> bytes:
        return _sized(key.encode()) if self.keys is None else varint(self.keys.setdefault(key, len(self.keys)))

    def value(self, v) -> bytes:
        new = self.keys is not None
        if v is None or v is False or v is True:
            return bytes([{None: NULL, False: FALSE, True: TRUE}[v]])
        if isinstance(v, Nanos):
            return bytes([TIME]) + struct.pack("<q", v)
        if isinstance(v, int):
            if new and 0 <= v <= 127:
                return bytes([FIXINT + v])
            if new and -16 <= v < 0:
                return bytes([FIXNEG - 1 - v])
            if -(1 << 63) <= v < 1 << 63:
                return bytes([INT]) + varint(zigzag(v))
            if v < 1 << 64 and v > 0:
                return bytes([UINT]) + varint(v)
            return bytes([BIGINT]) + _sized(v.to_bytes(v.bit_length() // 8 + 1, "big", signed=True))
        if isinstance(v, float):
            return bytes([DOUBLE]) + struct.pack("<d", v)
        if isinstance(v, str):
            return bytes([TEXT]) + _sized(v.encode())
        if isinstance(v, (bytes, bytearray)):
            return bytes([BYTES]) + _sized(bytes(v))
        if isinstance(v, Decimal):
            sign, digits, exponent = v.as_tuple()
            whole = int("".join(map(str, digits))) * (-1 if sign else 1)
            return bytes([DECIMAL]) + struct.pack("b", -exponent) + whole.to_bytes(16, "big", signed=True)
        if isinstance(v, uuid.UUID):
            return bytes([UUID_]) + v.bytes
        if isinstance(v, Extension):
            return bytes([EXT]) + varint(v.kind) + _sized(v.payload)
        if isinstance(v, Tensor):
            return bytes([TENSOR, v.dtype, len(v.dims)]) + b"".join(map(varint, v.dims)) + _sized(v.data)
        if isinstance(v, Bitmask):
            bits = bytearray(-(-len(v) // 8))
            for i, on in enumerate(v):
                bits[i // 8] |= bool(on) << i % 8
            return bytes([BITMASK]) + varint(len(v)) + bytes(bits)
        if (write := _WRITERS.get(type(v))) is not None:
            return write(self, v)
        if isinstance(v, (list, tuple)):
            if not new and (flat := self._typed(v)):
                return flat
            head = bytes([FIXARRAY + len(v)]) if new and len(v) < 16 else bytes([ARRAY]) + varint(len(v))
            return head + b"".join(map(self.value, v))
        if isinstance(v, dict):
            items = [(k, x) for k, x in v.items() if not (self.drop_nulls and x is None)]
            if self.sort_keys:
                items.sort(key=lambda kv: kv[0].encode())
            head = bytes([FIXMAP + len(items)]) if new and len(items) < 16 else bytes([OBJECT]) + varint(len(items))
            return head + b"".join(self._key(k) + self.value(x) for k, x in items)
        raise TypeError(f"no wire form for {type(v).__name__}")

    def _props(self, props: dict) -> bytes:
        return varint(len(props)) + b"".join(self._key(k) + self.value(x) for k, x in props.items())

    def _node(self, n: GraphNode) -> bytes:
        return _sized(n.id.encode()) + varint(len(n.labels)) + b"".join(_sized(x.encode()) for x in n.labels) + self._props(n.props)

    def _edge(self, e: GraphEdge) -> bytes:
        return b"".join(_sized(x.encode()) for x in (e.src, e.dst, e.type)) + self._props(e.props)

    def _shard(self, v: Shard) -> bytes:
        nodes = varint(len(v.nodes)) + b"".join(map(self._node, v.nodes))
        edges = varint(len(v.edges)) + b"".join(map(self._edge, v.edges))
        if v.kind != "shard":
            return bytes([NODES]) + nodes if v.kind == "nodes" else bytes([EDGES]) + edges
        return bytes([SHARD]) + nodes + edges + self._props(v.meta)

    def _rich(self, v: RichText) -> bytes:
        out = bytes([RICH_TEXT]) + _sized(v.text.encode()) + bytes([bool(v.tokens) | bool(v.spans) << 1])
        if v.tokens:
            out += varint(len(v.tokens)) + struct.pack(f"<{len(v.tokens)}i", *v.tokens)
        if v.spans:
            out += varint(len(v.spans)) + b"".join(varint(x) for span in v.spans for x in span)
        return out

    def _delta(self, v: Delta) -> bytes:
        ops = b"".join(bytes([op]) + varint(at) + (self.value(x) if op != 2 else b"") for op, at, x in v.ops)
        return bytes([DELTA]) + varint(v.base) + varint(len(v.ops)) + ops

    @staticmethod
    def _media(v: Media) -> bytes:
        head = struct.pack("<BHH", *v.about) if v.kind == "image" else struct.pack("<BIB", *v.about)
        return bytes([IMAGE if v.kind == "image" else AUDIO]) + head + _sized(v.data)

    @staticmethod
    def _adjacency(v: Adjacency) -> bytes:
        edges = len(v.indices) // v.width
        return bytes([ADJACENCY, v.width]) + varint(len(v.offsets) - 1) + varint(edges) + b"".join(map(varint, v.offsets)) + v.indices

    @staticmethod
    def _typed(v) -> bytes | None:
        """The compact form of a long enough array of one type (first generation)."""
        if len(v) < 4:
            return None
        if all(type(x) is int and -(1 << 63) <= x < 1 << 63 for x in v):
            return bytes([INTS]) + varint(len(v)) + struct.pack(f"<{len(v)}q", *v)
        if all(type(x) is float for x in v):
            return bytes([DOUBLES]) + varint(len(v)) + struct.pack(f"<{len(v)}d", *v)
        if all(type(x) is str for x in v):
            return bytes([TEXTS]) + varint(len(v)) + b"".join(_sized(x.encode()) for x in v)
        return None


_WRITERS = {
    TensorRef: lambda e, v: bytes([TENSOR_REF, v.store]) + _sized(v.key),
    Media: lambda e, v: e._media(v),
    Adjacency: lambda e, v: e._adjacency(v),
    RichText: lambda e, v: e._rich(v),
    Delta: lambda e, v: e._delta(v),
    GraphNode: lambda e, v: bytes([NODE]) + e._node(v),
    GraphEdge: lambda e, v: bytes([EDGE]) + e._edge(v),
    Shard: lambda e, v: e._shard(v),
}


def encode(
    v, generation: int = 2, drop_nulls: bool = False, sort_keys: bool = False, compression: str | None = None, hints: tuple[Hint, ...] = ()
) -> bytes:
    """One value as one document; with ``compression`` (gzip or zstd) if that is smaller and it has 256 bytes."""
    return b"".join(encode_parts(v, generation, drop_nulls, sort_keys, compression, hints))


def encode_parts(v, generation: int = 2, drop_nulls: bool = False, sort_keys: bool = False, compression: str | None = None, hints: tuple[Hint, ...] = ()):
    """The pieces of a document in order, for writers that gather them without a copy."""
    if generation == 1:
        return [Encoder(None, drop_nulls, sort_keys).value(v)]
    keys: dict[str, int] = {}
    root = Encoder(keys, drop_nulls, sort_keys).value(v)
    about = b""
    if hints:
        about = varint(len(hints))
        for h in hints:
            about += _sized(h.field.encode()) + bytes([h.type]) + varint(len(h.shape)) + b"".join(map(varint, h.shape)) + bytes([h.flags])
    names = varint(len(keys)) + b"".join(_sized(k.encode()) for k in keys)
    flags = HAS_HINTS if hints else 0
    if compression and len(about) + len(names) + len(root) >= COMPRESS_FROM:
        body = about + names + root
        small = compress(body, compression)
        if len(small) < len(body):
            return [MAGIC, bytes([flags | 1 | (1 if compression == "gzip" else 2) << 1]), varint(len(body)), small]
    return [MAGIC, bytes([flags]), about, names, root]


def compress(data: bytes, compression: str) -> bytes:
    """gzip or zstd."""
    if compression == "gzip":
        return gzip.compress(data, mtime=0)
    import zstandard

    return zstandard.compress(data)


class Decoder:
    """Bytes to values within limits."""

    def __init__(self, data: bytes, limits: Limits, keys: list[str] | None):
        self.data, self.at, self.limits, self.keys = data, 0, limits, keys

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise WireError("ERR_TRUNCATED")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 127) << shift
            if b < 128:
                if n >= 1 << 64:
                    raise WireError("ERR_INVALID_VARINT")
                return n
            shift += 7
            if shift > 63:
                raise WireError("ERR_INVALID_VARINT")

    def count(self) -> int:
        n = self.varint()
        if n > self.limits.items:
            raise WireError("ERR_TOO_LARGE")
        return n

    def text(self) -> str:
        n = self.varint()
        if n > self.limits.text:
            raise WireError("ERR_STRING_TOO_LARGE")
        try:
            return self.take(n).decode()
        except UnicodeDecodeError:
            raise WireError("ERR_INVALID_UTF8") from None

    def blob(self) -> bytes:
        n = self.varint()
        if n > self.limits.data:
            raise WireError("ERR_BYTES_TOO_LARGE")
        return self.take(n)

    def members(self, n: int, depth: int) -> dict:
        out = {}
        for _ in range(n):
            if self.keys is None:
                key = self.text()
            else:
                k = self.varint()
                if k >= len(self.keys):
                    raise WireError("ERR_INVALID_FIELD_ID")
                key = self.keys[k]
            out[key] = self.value(depth + 1)
        return out

    def value(self, depth: int = 0):
        if depth > self.limits.depth:
            raise WireError("ERR_TOO_DEEP")
        tag = self.take(1)[0]
        if tag >= RESERVED:
            raise WireError("ERR_INVALID_TAG")
        if tag >= FIXNEG:
            return FIXNEG - 1 - tag
        if tag >= FIXMAP:
            return self.members(tag - FIXMAP, depth)
        if tag >= FIXARRAY:
            return [self.value(depth + 1) for _ in range(tag - FIXARRAY)]
        if tag >= FIXINT:
            return tag - FIXINT
        read = _READERS.get(tag)
        if read is None:
            raise WireError("ERR_INVALID_TAG")
        return read(self, depth)


def _tensor(d: Decoder, depth: int) -> Tensor:
    dtype, rank = d.take(2)
    if rank > d.limits.rank:
        raise WireError("ERR_RANK_TOO_LARGE")
    dims = tuple(d.varint() for _ in range(rank))
    return Tensor(dtype, dims, d.blob())


def _bitmask(d: Decoder, depth: int) -> Bitmask:
    n = d.count()
    bits = d.take(-(-n // 8))
    return Bitmask(bool(bits[i // 8] >> i % 8 & 1) for i in range(n))


def _node(d: Decoder, depth: int) -> GraphNode:
    return GraphNode(d.text(), [d.text() for _ in range(d.count())], d.members(d.count(), depth))


def _edge(d: Decoder, depth: int) -> GraphEdge:
    return GraphEdge(d.text(), d.text(), d.text(), d.members(d.count(), depth))


def _several(read):
    return lambda d, depth: [read(d, depth + 1) for _ in range(d.count())]


def _rich_text(d: Decoder, depth: int) -> RichText:
    text, flags = d.text(), d.take(1)[0]
    n = d.count() if flags & 1 else 0
    tokens = list(struct.unpack(f"<{n}i", d.take(4 * n)))
    spans = [(d.varint(), d.varint(), d.varint()) for _ in range(d.count() if flags & 2 else 0)]
    return RichText(text, tokens, spans)


def _delta(d: Decoder, depth: int) -> Delta:
    base, ops = d.varint(), []
    for _ in range(d.count()):
        op = d.take(1)[0]
        ops.append((op, d.varint(), d.value(depth + 1) if op != 2 else None))
    return Delta(base, ops)


def _adjacency(d: Decoder, depth: int) -> Adjacency:
    width, nodes, edges = d.take(1)[0], d.count(), d.count()
    return Adjacency(width, [d.varint() for _ in range(nodes + 1)], d.take(edges * width))


def _packed(code: str, size: int):
    def read(d: Decoder, depth: int):
        n = d.count()
        return list(struct.unpack(f"<{n}{code}", d.take(n * size)))

    return read


def _signed(n: int) -> int:
    return n >> 1 if n & 1 == 0 else -(n >> 1) - 1


_READERS = {
    NULL: lambda d, _: None,
    FALSE: lambda d, _: False,
    TRUE: lambda d, _: True,
    INT: lambda d, _: _signed(d.varint()),
    DOUBLE: lambda d, _: struct.unpack("<d", d.take(8))[0],
    FLOAT: lambda d, _: struct.unpack("<f", d.take(4))[0],
    TEXT: lambda d, _: d.text(),
    BYTES: lambda d, _: d.blob(),
    UINT: lambda d, _: d.varint(),
    ARRAY: lambda d, depth: [d.value(depth + 1) for _ in range(d.count())],
    OBJECT: lambda d, depth: d.members(d.count(), depth),
    TIME: lambda d, _: Nanos(struct.unpack("<q", d.take(8))[0]),
    UUID_: lambda d, _: uuid.UUID(bytes=d.take(16)),
    BIGINT: lambda d, _: int.from_bytes(d.blob(), "big", signed=True),
    EXT: lambda d, _: Extension(d.varint(), d.blob()),
    INTS: _packed("q", 8),
    DOUBLES: _packed("d", 8),
    FLOATS: _packed("f", 4),
    TEXTS: lambda d, _: [d.text() for _ in range(d.count())],
    TENSOR: _tensor,
    BITMASK: _bitmask,
    TENSOR_REF: lambda d, _: TensorRef(d.take(1)[0], d.blob()),
    IMAGE: lambda d, _: Media("image", struct.unpack("<BHH", d.take(5)), d.blob()),
    AUDIO: lambda d, _: Media("audio", struct.unpack("<BIB", d.take(6)), d.blob()),
    ADJACENCY: _adjacency,
    RICH_TEXT: _rich_text,
    DELTA: _delta,
    NODE: _node,
    EDGE: _edge,
    NODES: lambda d, depth: Shard(_several(_node)(d, depth), [], {}, "nodes"),
    EDGES: lambda d, depth: Shard([], _several(_edge)(d, depth), {}, "edges"),
    SHARD: lambda d, depth: Shard(_several(_node)(d, depth), _several(_edge)(d, depth), d.members(d.count(), depth)),
}


def _decimal(d: Decoder) -> Decimal:
    scale = struct.unpack("b", d.take(1))[0]
    whole = int.from_bytes(d.take(16), "big", signed=True)
    return Decimal((int(whole < 0), tuple(map(int, str(abs(whole)))), -scale))


_READERS[DECIMAL] = lambda d, _: _decimal(d)


def _deep() -> None:
    """Room for the deepest nesting that the limits allow by default."""
    wanted = 4 * Limits().depth + 1000
    if sys.getrecursionlimit() < wanted:
        sys.setrecursionlimit(wanted)


def decode(data: bytes, limits: Limits | None = None):
    """The value of one whole document of either generation; bytes after it are an error."""
    return _opened(data, limits or Limits(), _root)


def decode_prefix(data: bytes, limits: Limits | None = None, generation: int = 2) -> tuple[object, int]:
    """The value of the document that a binary begins with, and the bytes it takes."""
    limits = limits or Limits()
    if generation == 1:
        _deep()
        d = Decoder(data, limits, None)
        return d.value(), d.at

    def first(d: Decoder):
        return d.value(), 4 + d.at

    if data[:3] == MAGIC and len(data) > 3 and data[3] & 1:  # a compressed document does not say where it ends
        return decode(data, limits), len(data)
    return _opened(data, limits, first)


def hints_of(data: bytes, limits: Limits | None = None) -> list[Hint]:
    """The column hints of a document."""
    found: list[Hint] = []
    _opened(data, limits or Limits(), lambda d: None, found)
    return found


def fields_of(data: bytes, limits: Limits | None = None) -> list[str]:
    """The dictionary of a document, read without its value."""
    return _opened(data, limits or Limits(), lambda d: d.keys or [])


def _opened(data: bytes, limits: Limits, then, hints: list[Hint] | None = None):
    _deep()
    if data[:3] != MAGIC:
        return then(Decoder(data, limits, None))
    if len(data) < 4:
        raise WireError("ERR_TRUNCATED")
    flags, body = data[3], data[4:]
    if flags & 1:
        head = Decoder(body, limits, None)
        size = head.varint()
        if size > limits.decompressed:
            raise WireError("ERR_DECOMPRESSED_TOO_LARGE")
        body = expand(body[head.at :], flags >> 1 & 3, size)
    d = Decoder(body, limits, [])
    if flags & HAS_HINTS:
        for _ in range(d.count()):
            hint = Hint(d.text(), d.take(1)[0], tuple(d.varint() for _ in range(d.count())), d.take(1)[0])
            if hints is not None:
                hints.append(hint)
    d.keys = [d.text() for _ in range(d.count())]
    return then(d)


def expand(data: bytes, kind: int, size: int) -> bytes:
    """``size`` bytes from gzip (1) or zstd (2); damaged data is an error like any other."""
    try:
        if kind == 1:
            out = zlib.decompressobj(31).decompress(data, size + 1)
        elif kind == 2:
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(data) as reader:
                out = reader.read(size + 1)
        else:
            raise WireError("ERR_UNSUPPORTED_COMPRESSION")
    except (zlib.error, EOFError) as e:
        raise WireError("ERR_DECOMPRESS") from e
    except Exception as e:  # zstandard is optional, and so is its error's name
        if type(e).__name__ == "ZstdError":
            raise WireError("ERR_DECOMPRESS") from e
        raise
    if len(out) != size:
        raise WireError("ERR_DECOMPRESSED_MISMATCH")
    return out


def _root(d: Decoder):
    v = d.value()
    if d.at != len(d.data):
        raise WireError("ERR_TRAILING_DATA")
    return v


def jsonable(v):
    """A value in its JSON form."""
    if isinstance(v, Nanos):
        seconds, rest = divmod(int(v), 1_000_000_000)
        whole = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)
        return whole.strftime("%Y-%m-%dT%H:%M:%S") + (f".{rest:09d}".rstrip("0") if rest else "") + "Z"
    if isinstance(v, int) and not isinstance(v, bool) and abs(v) > 1 << 53:
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return base64.b64encode(v).decode()
    if isinstance(v, (Decimal, uuid.UUID)):
        return str(v)
    if isinstance(v, Tensor):
        return {"_type": "tensor", "dtype": v.dtype, "dims": list(v.dims), "data": base64.b64encode(v.data).decode()}
    if isinstance(v, Extension):
        return {"_type": "ext", "ext_type": v.kind, "payload": base64.b64encode(v.payload).decode()}
    if isinstance(v, list):
        return [jsonable(x) for x in v]
    if isinstance(v, dict):
        return {k: jsonable(x) for k, x in v.items()}
    if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
        return None
    if isinstance(v, TensorRef):
        return {"_type": "tensor_ref", "store": v.store, "key": base64.b64encode(v.key).decode()}
    if isinstance(v, Media):
        names = ("format", "width", "height") if v.kind == "image" else ("encoding", "rate", "channels")
        return {"_type": v.kind, **dict(zip(names, v.about, strict=True)), "data": base64.b64encode(v.data).decode()}
    if isinstance(v, Adjacency):
        ids = [int.from_bytes(v.indices[i : i + v.width], "little") for i in range(0, len(v.indices), v.width)]
        return {"_type": "adjacency", "offsets": v.offsets, "indices": ids}
    if isinstance(v, RichText):
        return {"_type": "rich_text", "text": v.text, "tokens": v.tokens, "spans": [list(x) for x in v.spans]}
    if isinstance(v, Delta):
        return {"_type": "delta", "base": v.base, "ops": [{"op": o, "field": f, "value": jsonable(x)} for o, f, x in v.ops]}
    if isinstance(v, GraphNode):
        return {"_type": "node", "id": v.id, "labels": v.labels, "props": jsonable(v.props)}
    if isinstance(v, GraphEdge):
        return {"_type": "edge", "from": v.src, "to": v.dst, "type": v.type, "props": jsonable(v.props)}
    if isinstance(v, Shard):
        return {"_type": v.kind, "nodes": jsonable(v.nodes), "edges": jsonable(v.edges), "meta": jsonable(v.meta)}
    return v


def type_tag(v) -> int:
    """The number of a value's type in a fingerprint."""
    if v is None:
        return 0
    for kind, name in _TYPE_NAMES:
        if isinstance(v, kind):
            if name == "int" and not -(1 << 63) <= v < 1 << 63:
                name = "uint" if 0 < v < 1 << 64 else "bigint"
            return TYPES.index(v.kind if name in ("media", "shard") else name)
    raise TypeError(f"no wire form for {type(v).__name__}")


_TYPE_NAMES = (
    (bool, "bool"), (Nanos, "datetime"), (int, "int"), (float, "float"), (Decimal, "decimal"), (str, "string"), ((bytes, bytearray), "bytes"), (uuid.UUID, "uuid"),
    (Bitmask, "bitmask"), (list, "array"), (dict, "object"), (Tensor, "tensor"), (TensorRef, "tensor_ref"), (Media, "media"), (Adjacency, "adjacency"),
    (RichText, "rich_text"), (Delta, "delta"), (GraphNode, "node"), (GraphEdge, "edge"), (Shard, "shard"), (Extension, "ext"),
)


def from_json(text: str):
    """JSON text as a value; integral floats within 2**53 become integers, the last of equal keys wins."""

    def number(s: str):
        x = float(s)
        return int(x) if x.is_integer() and abs(x) <= 1 << 53 else x

    return json.loads(text, parse_float=number)


def _encoded(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            return None if t is None else encode(from_json(t))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def _decoded(documents: pd.Series) -> pd.Series:
    def one(b):
        try:
            return None if b is None else json.dumps(jsonable(decode(b)), separators=(",", ":"), ensure_ascii=False)
        except (WireError, RecursionError):
            return None

    return documents.map(one)


def to_wire(column: str | Column) -> Column:
    """JSON text as second-generation documents; text that is no JSON becomes null."""
    return F.pandas_udf(_encoded, "binary")(column)


def wire_to_json(column: str | Column) -> Column:
    """Documents of either generation as JSON text; bytes that are no document become null."""
    return F.pandas_udf(_decoded, "string")(column)


def bridged(column: str | Column) -> Column:
    """struct<same_text,same_document> of JSON text: are its canonical text and its document the same after text to document and back?

    Each step runs once for a text: as columns, every use of a step would run it and all before it again.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        from tessera.functions.canonical import _canonical_texts
        from tessera.functions.textcodec import _json, _each, parse_document

        read = _each(lambda t: _json(parse_document(t)))
        rows, distinct = pd.factorize(texts, use_na_sentinel=False)  # equal texts have equal results
        text = _canonical_texts(pd.Series(distinct, dtype=object).where(lambda t: t.notna(), None))
        document = _encoded(read(text))
        again = _canonical_texts(_decoded(document))
        second = _encoded(read(again))
        same = [[None if x is None or y is None else x == y for x, y in zip(a, b, strict=True)] for a, b in ((again, text), (second, document))]
        return pd.DataFrame({name: pd.Series([held[i] for i in rows], dtype=object) for name, held in zip(("same_text", "same_document"), same, strict=True)})

    return F.pandas_udf(run, "struct<same_text:boolean,same_document:boolean>")(column)


# Bytes that stand for a type in a fingerprint.
_SHAPES = {type(None): NULL, bool: FALSE, int: INT, float: DOUBLE, str: TEXT, bytes: BYTES, Decimal: DECIMAL, Nanos: TIME, uuid.UUID: UUID_}


def shape_of(v) -> str:
    """The shape of a value: sorted names and types, arrays by their elements."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{shape_of(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(shape_of(x) for x in v) + "]"
    if isinstance(v, Tensor):
        return f"tensor({v.dtype},{len(v.dims)})"
    return {NULL: "null", FALSE: "bool", INT: "int", DOUBLE: "float", TEXT: "string", BYTES: "bytes", DECIMAL: "decimal", TIME: "datetime", UUID_: "uuid"}.get(_SHAPES.get(type(v)), "ext")


def sniff(content: Column) -> Column:
    """What a binary is by its first bytes: gen2, gen2_compressed or gen1."""
    head = F.hex(F.substring(content, 1, 3))
    flags = F.conv(F.hex(F.substring(content, 4, 1)), 16, 10).cast("int")
    return F.when(head != MAGIC.hex().upper(), "gen1").when(flags.bitwiseAND(F.lit(1)) == 1, "gen2_compressed").otherwise("gen2")


def read_documents(spark: SparkSession, path: str, max_bytes: int = 1 << 28, too_large: str = "fail") -> DataFrame:
    """(path, length, json) of files with one document each.

    A file above ``max_bytes`` fails the read before its bytes are decoded, or with ``too_large`` "null" has a null
    document, or with "drop" is left out.
    """
    files = spark.read.format("binaryFile").load(path)
    if too_large == "drop":
        files = files.where(F.col("length") <= max_bytes)
    fits = F.col("length") <= max_bytes
    content = F.when(fits, F.col("content"))
    if too_large == "fail":
        content = F.when(fits, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("ERR_TOO_LARGE: "), "path")).cast("binary"))
    return files.select("path", "length", wire_to_json(content).alias("json"))


def write_length_prefixed(documents: list[bytes]) -> bytes:
    """A stream of documents, each after its length as 32 little-endian bits, with a length of 0 at the end."""
    return b"".join(struct.pack("<I", len(d)) + d for d in documents) + struct.pack("<I", 0)


def split_length_prefixed(data: bytes):
    """(payload) of the documents of a length-prefixed stream, as JSON text."""
    at = 0
    while at + 4 <= len(data):
        n = struct.unpack_from("<I", data, at)[0]
        if n == 0:
            return
        if at + 4 + n > len(data):
            raise WireError("ERR_TRUNCATED")
        yield {"json": json.dumps(jsonable(decode(bytes(data[at + 4 : at + 4 + n]))), separators=(",", ":"), ensure_ascii=False)}
        at += 4 + n


def read_length_prefixed(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, json, error) of the documents in files of length-prefixed streams."""
    from tessera.sources.frames import read_frames

    return read_frames(spark, path, split_length_prefixed, "json string")
