"""Graph-learning datasets: a container file of metadata, node and edge tables, features, splits and compressed rows.

In Spark a dataset is a set of DataFrames; this module reads a container into them and writes one from them.
A container is one binary by its nature, and so is each section of it: they are built and read in one task,
row by row, never on the driver.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import frames, wire
from tessera.sources.wire import Decoder, Limits, WireError, varint

# Magics, kinds of sections, their encodings, flags, and types of elements.
MAGIC, PACKED_MAGIC = b"SJGN", b"SJGZ"
SECTION_KINDS = ("meta", "node_table", "edge_table", "feature", "split", "aux")
JSON, BINARY, RAW, EVENTS = range(4)
HETEROGENEOUS, TEMPORAL, HAS_CSR, PACKED = 1, 2, 4, 8
ELEMENTS = {"float32": "<f4", "float64": "<f8", "int32": "<i4", "int64": "<i8", "uint32": "<u4", "uint64": "<u8", "bool": "?", "float16": "<f2"}
ROW_WISE, BLOCKED = 0, 1
INDICES, MASKS = 0, 1
#: Bytes that a packed container may hold.
MAX_UNPACKED = 256 << 20


def _sized(data: bytes) -> bytes:
    return varint(len(data)) + data


def _reader(data: bytes) -> Decoder:
    return Decoder(data, Limits(items=1 << 40, data=1 << 40, text=1 << 31), None)


@dataclass
class Section:
    """A named part of a container."""

    kind: str
    name: str
    body: bytes
    encoding: int = -1

    def __post_init__(self) -> None:
        if self.encoding < 0:
            self.encoding = {"feature": RAW, "node_table": EVENTS, "edge_table": EVENTS}.get(self.kind, JSON)


@dataclass
class Dataset:
    """A container: metadata, flags and sections by (kind, name)."""

    name: str
    directed: bool = True
    flags: int = 0
    edge_types: list[tuple[str, str, str]] = field(default_factory=list)
    id_spaces: dict[str, tuple[int, int]] = field(default_factory=dict)
    features: dict[str, tuple[str, list[int]]] = field(default_factory=dict)
    labels: dict[str, tuple[str, list[int]]] = field(default_factory=dict)
    sections: list[Section] = field(default_factory=list)

    def add_edge_type(self, src: str, edge: str, dst: str) -> Dataset:
        self.edge_types.append((src, edge, dst))
        if len(self.edge_types) > 1 or src != dst:
            self.flags |= HETEROGENEOUS
        return self

    def add_feature(self, owner: str, name: str, dtype: str, shape: list[int]) -> Dataset:
        self.features[f"{owner}:{name}"] = (dtype, list(shape))
        return self

    def add_label(self, owner: str, name: str, dtype: str, shape: list[int]) -> Dataset:
        self.labels[f"{owner}:{name}"] = (dtype, list(shape))
        return self

    def section(self, name: str) -> Section | None:
        return next((s for s in self.sections if s.name == name), None)

    def of_kind(self, kind: str) -> list[Section]:
        return [s for s in self.sections if s.kind == kind]

    def meta(self) -> dict:
        out = {"dataset_name": self.name, "directed": self.directed}
        if self.flags & TEMPORAL:
            out["temporal"] = True
        if self.flags & HETEROGENEOUS:
            out["heterogeneous"] = True
        if self.edge_types:
            out["edge_types"] = [dict(zip(("src_type", "edge_type", "dst_type"), t, strict=True)) for t in self.edge_types]
        if self.id_spaces:
            out["id_spaces"] = {k: {"start": a, "count": n} for k, (a, n) in self.id_spaces.items()}
        for name, held in (("features", self.features), ("labels", self.labels)):
            if held:
                out[name] = {k: {"shape": shape, "dtype": dtype} for k, (dtype, shape) in held.items()}
        return out


def encode_dataset(d: Dataset, minor: bool = True, packed: bool = False) -> bytes:
    """The container's bytes; ``minor`` writes version 1.1, whose sections name their encoding and whose metadata is binary."""
    body = wire.encode(d.meta()) if minor else json.dumps(d.meta(), separators=(",", ":")).encode()
    sections = [Section("meta", "meta", body, BINARY if minor else JSON), *d.sections]
    out = MAGIC + (b"\x01\x10" if minor else b"\x01") + bytes([d.flags]) + varint(len(sections))
    for s in sections:
        out += varint(SECTION_KINDS.index(s.kind)) + (bytes([s.encoding]) if minor else b"") + _sized(s.name.encode()) + struct.pack("<Q", len(s.body)) + s.body
    if packed:
        out = PACKED_MAGIC + struct.pack("<I", len(out)) + wire.compress(out, "zstd")
    return out


def decode_dataset(data: bytes) -> Dataset:
    """The container of either version, packed or not."""
    if data[:4] == PACKED_MAGIC:
        size = struct.unpack("<I", data[4:8])[0]
        if size > MAX_UNPACKED:
            raise WireError("ERR_DECOMPRESSED_TOO_LARGE")
        data = wire.expand(data[8:], 2, size)
    if data[:4] != MAGIC:
        raise WireError("ERR_INVALID_MAGIC")
    d = _reader(data)
    d.at = 4
    if d.take(1) != b"\x01":
        raise WireError("ERR_INVALID_VERSION")
    second = d.take(1)[0]
    minor = second == 0x10
    flags = d.take(1)[0] if minor else second
    out = Dataset("", flags=flags)
    for _ in range(d.count()):
        kind = d.varint()
        if kind >= len(SECTION_KINDS):
            raise WireError("ERR_INVALID_TAG")
        encoding = d.take(1)[0] if minor else -1
        name = d.text()
        s = Section(SECTION_KINDS[kind], name, d.take(struct.unpack("<Q", d.take(8))[0]), encoding)
        if s.kind != "meta":
            out.sections.append(s)
            continue
        meta = wire.decode(s.body) if s.encoding == BINARY else json.loads(s.body)
        out.name, out.directed = meta.get("dataset_name", ""), bool(meta.get("directed", True))
        out.edge_types = [(t["src_type"], t["edge_type"], t["dst_type"]) for t in meta.get("edge_types", [])]
        out.id_spaces = {k: (v["start"], v["count"]) for k, v in meta.get("id_spaces", {}).items()}
        out.features = {k: (v["dtype"], v["shape"]) for k, v in meta.get("features", {}).items()}
        out.labels = {k: (v["dtype"], v["shape"]) for k, v in meta.get("labels", {}).items()}
    return out


# --- sections ---


def feature_section(name: str, dtype: str, shape: list[int], rows: np.ndarray, ids: list[int] | None = None) -> Section:
    """A feature as one block, or row by row with ``ids``."""
    mode = BLOCKED if ids is None else ROW_WISE
    head = bytes([mode]) + _sized(name.encode()) + bytes([list(ELEMENTS).index(dtype)]) + varint(len(shape)) + b"".join(map(varint, shape))
    data = np.asarray(rows, dtype=ELEMENTS[dtype]).reshape(len(rows), -1)
    if ids is None:
        return Section("feature", name, head + varint(len(data)) + data.tobytes())
    return Section("feature", name, head + b"".join(varint(i) + row.tobytes() for i, row in zip(ids, data, strict=True)))


def read_feature(body: bytes, dtype: str | None = None) -> tuple[str, list[int], np.ndarray]:
    """(name, ids, rows) of a feature section; another element type than ``dtype`` is an error."""
    d = _reader(body)
    mode, name = d.take(1)[0], d.text()
    found = list(ELEMENTS)[d.take(1)[0]]
    if dtype not in (None, found):
        raise WireError("ERR_TYPE_MISMATCH")
    shape = [d.varint() for _ in range(d.count())]
    kind = np.dtype(ELEMENTS[found])
    width = int(np.prod(shape)) if shape else 1
    if mode == BLOCKED:
        n = d.varint()
        return name, list(range(n)), np.frombuffer(d.take(n * width * kind.itemsize), kind).reshape(n, width)
    ids, rows = [], []
    while d.at < len(body):
        ids.append(d.varint())
        rows.append(np.frombuffer(d.take(width * kind.itemsize), kind))
    return name, ids, np.array(rows, dtype=kind).reshape(len(ids), width)


def split_section(name: str, parts: dict[str, list[int]], n_nodes: int | None = None) -> Section:
    """Train, validation and test members as indices, or as masks over ``n_nodes``."""
    held = [parts.get(k, []) for k in ("train", "val", "test")]
    if n_nodes is None:
        return Section("split", name, bytes([INDICES]) + b"".join(varint(len(x)) + struct.pack(f"<{len(x)}q", *x) for x in held))
    masks = []
    for members in held:
        bits = np.zeros(n_nodes, dtype=bool)
        bits[[i for i in members if 0 <= i < n_nodes]] = True
        masks.append(_sized(np.packbits(bits, bitorder="little").tobytes()))
    return Section("split", name, bytes([MASKS]) + varint(n_nodes) + b"".join(masks))


def read_split(body: bytes) -> dict[str, list[int]]:
    """Members of train, val and test of a split section of either mode."""
    d = _reader(body)
    if d.take(1)[0] == INDICES:
        return {k: list(struct.unpack(f"<{n}q", d.take(8 * n))) for k in ("train", "val", "test") for n in [d.varint()]}
    n = d.varint()
    return {k: np.flatnonzero(np.unpackbits(np.frombuffer(d.blob(), np.uint8), bitorder="little")[:n]).tolist() for k in ("train", "val", "test")}


def rows_section(name: str, offsets: list[int], indices: list[int], columns: bool = False) -> Section:
    """Compressed rows, or columns, of a graph as 64-bit little-endian arrays."""
    head = bytes([int(columns)]) + varint(len(offsets) - 1) + varint(len(indices))
    return Section("aux", name, head + _sized(np.asarray(offsets, "<i8").tobytes()) + _sized(np.asarray(indices, "<i8").tobytes()))


def read_rows(body: bytes) -> dict:
    """format, n_nodes, n_edges, offsets and indices of compressed rows."""
    d = _reader(body)
    columns, n, m = d.take(1)[0], d.varint(), d.varint()
    offsets, indices = (np.frombuffer(d.blob(), "<i8").tolist() for _ in range(2))
    return {"format": "csc" if columns else "csr", "n_nodes": n, "n_edges": m, "offsets": offsets, "indices": indices}


def node_section(name: str, nodes: list[dict]) -> Section:
    """Node records {id, labels, props, ts} as an event stream; a record's own dict is left as it is."""
    return Section("node_table", name, frames.event_stream([{**n, "kind": "node", "id": str(n["id"]), "props": _with(n, "ts")} for n in nodes]))


def edge_section(name: str, edges: list[dict], label: str = "edge") -> Section:
    """Edge records {src, dst, ts, weight, props} as an event stream."""
    return Section("edge_table", name, frames.event_stream([{"kind": "edge", "label": label, "src": str(e["src"]), "dst": str(e["dst"]), "props": _with(e, "ts", "weight")} for e in edges]))


def _with(record: dict, *names: str) -> dict:
    lifted = {{"ts": "_ts"}.get(n, n): record[n] for n in names if record.get(n) is not None}
    return {**(record.get("props") or {}), **lifted}


def read_nodes(body: bytes) -> list[dict]:
    """(id, labels, ts, props) of a node table; a missing time is 0."""
    out = []
    for e in frames.split_events(body):
        props = json.loads(e["props"] or "{}")
        out.append({"id": int(e["id"]), "labels": e.get("labels", []), "ts": int(props.pop("_ts", 0)), "props": json.dumps(props, separators=(",", ":"))})
    return out


def read_edges(body: bytes) -> list[dict]:
    """(src, dst, ts, weight, props) of an edge table; a missing time or weight is 0."""
    out = []
    for e in frames.split_events(body):
        props = json.loads(e["props"] or "{}")
        ts, weight = int(props.pop("_ts", 0)), float(props.pop("weight", 0))
        out.append({"src": int(e["src"]), "dst": int(e["dst"]), "ts": ts, "weight": weight, "props": json.dumps(props, separators=(",", ":"))})
    return out


# --- DataFrames ---

_SCHEMAS = {
    "node_table": ("id long, labels array<string>, ts long, props string", read_nodes),
    "edge_table": ("src long, dst long, ts long, weight double, props string", read_edges),
    "feature": ("id long, values array<double>", lambda b: [{"id": i, "values": [float(x) for x in row]} for i, row in zip(*read_feature(b)[1:], strict=True)]),
    "split": ("part string, id long", lambda b: [{"part": k, "id": i} for k, held in read_split(b).items() for i in held]),
    "aux": ("format string, n_nodes long, n_edges long, offsets array<long>, indices array<long>", lambda b: [read_rows(b)]),
}


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, dataset, flags, kind, name, encoding, body, meta, error): one row for each section of the containers in files."""

    def split(data: bytes):
        d = decode_dataset(data)
        meta = json.dumps(d.meta(), separators=(",", ":"))
        for s in [Section("meta", "meta", b""), *d.sections]:
            yield {"dataset": d.name, "flags": d.flags, "kind": s.kind, "name": s.name, "encoding": s.encoding, "body": s.body, "meta": meta if s.kind == "meta" else None}

    return frames.read_frames(spark, path, split, "dataset string, flags int, kind string, name string, encoding int, body binary, meta string")


def section_rows(sections: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """Rows of all sections of a kind (``node_table``, ``edge_table``, ``feature``, ``split`` or ``aux``) beside their ``name``."""
    fields, read = _SCHEMAS[kind]
    given = sections.where(F.col("kind") == kind).select("name", F.col(body).alias("body"))
    schema = given.sparkSession.createDataFrame([], f"name string, {fields}").schema

    def rows(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        import pyarrow as pa

        target = to_arrow_schema(schema)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = read(content.as_py())  # a section is bounded by its writer
                for at in range(0, len(found), 4096):
                    yield pa.RecordBatch.from_pylist([{"name": name, **r} for r in found[at : at + 4096]], schema=target)

    return given.mapInArrow(rows, schema)


#: Rows of a section of nodes, edges or features, about: larger ones are several sections of one name.
SECTION_ROWS = 50_000


def section_bodies(df: DataFrame, key: str, kind: str, name: str, order: str, **options) -> DataFrame:
    """(key, kind, name, body, part): the rows of each key as sections, built where they meet.

    Node tables take id, labels, ts, props; edge tables src, dst, ts, weight, props; features id and values; splits part and id.
    Keys of more than ``SECTION_ROWS`` rows have several sections, each of which stands for itself; a split stays one.
    """
    writers = {
        "node_table": lambda rows: node_section(name, rows),
        "edge_table": lambda rows: edge_section(name, rows),
        "feature": lambda rows: feature_section(name, options.get("dtype", "float32"), options["shape"], np.array([r["values"] for r in rows]), [r["id"] for r in rows] if options.get("row_wise") else None),
        "split": lambda rows: split_section(name, {p: [r["id"] for r in rows if r["part"] == p] for p in ("train", "val", "test")}, options.get("n_nodes")),
    }
    write = writers[kind]

    def build(group: pd.DataFrame) -> pd.DataFrame:
        rows = [{k: v for k, v in r.items() if k != "_part" and not (v is None or (isinstance(v, float) and v != v))} for r in group.sort_values(order).to_dict("records")]
        for r in rows:
            if "labels" in r:
                r["labels"] = list(r["labels"])
            if isinstance(r.get("props"), str):
                r["props"] = json.loads(r["props"])
        return pd.DataFrame({key: [group[key].iloc[0]], "kind": [kind], "name": [name], "body": [write(rows).body], "part": [int(group["_part"].iloc[0])]})

    sizes = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / SECTION_ROWS).alias("_parts"))
    placed = df.join(sizes.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")))
    dealt = placed.select(*df.columns, (F.lit(0) if kind == "split" else F.pmod(F.xxhash64(*df.columns), F.col("_parts"))).cast("long").alias("_part"))
    return dealt.groupBy(key, "_part").applyInPandas(build, f"`{key}` {df.schema[key].dataType.simpleString()}, kind string, name string, body binary, part long")


def container(meta: Dataset, sections: Column, minor: bool = True, packed: bool = False) -> Column:
    """Containers from arrays of struct<kind,name,body>, all with the metadata of ``meta``."""

    def one(held) -> bytes:
        d = Dataset(meta.name, meta.directed, meta.flags, meta.edge_types, meta.id_spaces, meta.features, meta.labels)
        d.sections = [Section(s["kind"], s["name"], bytes(s["body"])) for s in held]
        return encode_dataset(d, minor, packed)

    def run(column: pd.Series) -> pd.Series:
        return column.map(one)

    return F.pandas_udf(run, "binary")(sections)


def container_sections(column: str | Column) -> Column:
    """An array of struct<kind,name,encoding,body> of the sections in a binary; null where it is no container."""

    def one(b):
        try:
            return None if b is None else [{"kind": s.kind, "name": s.name, "encoding": s.encoding, "body": s.body} for s in decode_dataset(bytes(b)).sections]
        except WireError:
            return None

    def run(contents: pd.Series) -> pd.Series:
        return contents.map(one)

    return F.pandas_udf(run, "array<struct<kind:string,name:string,encoding:int,body:binary>>")(column)


def to_numpy(d: Dataset) -> dict:
    """Arrays of a container for a learning framework: features, edge_index, splits and compressed rows by name."""
    out: dict = {"features": {}, "edge_index": {}, "splits": {}, "rows": {}, "ids": {}}
    for s in d.sections:
        if s.kind == "feature":
            out["features"][s.name] = read_feature(s.body)[2]
        elif s.kind == "edge_table":
            edges = read_edges(s.body)
            out["edge_index"][s.name] = np.array([[e["src"] for e in edges], [e["dst"] for e in edges]], dtype=np.int64)
        elif s.kind == "node_table":
            out["ids"][s.name] = np.array([n["id"] for n in read_nodes(s.body)], dtype=np.int64)
        elif s.kind == "split":
            out["splits"][s.name] = {k: np.array(v, dtype=np.int64) for k, v in read_split(s.body).items()}
        else:
            held = read_rows(s.body)
            out["rows"][s.name] = np.array(held["offsets"]), np.array(held["indices"])
    return out


def to_torch(d: Dataset, device: str | None = None) -> dict:
    """The arrays of :func:`to_numpy` as tensors, where the framework is installed."""
    import torch  # an optional framework: its absence is the caller's error

    def moved(x):
        if isinstance(x, dict):
            return {k: moved(v) for k, v in x.items()}
        if isinstance(x, tuple):
            return tuple(moved(v) for v in x)
        return torch.as_tensor(x, device=device)

    return moved(to_numpy(d))


# --- shards ---


#: Nodes and edges that a document of a shard holds, about: readers take a million of each, and a task holds one document.
SHARD_ROWS = 50_000


def graph_shards(nodes: DataFrame, edges: DataFrame, n_shards: int, meta: dict | None = None) -> DataFrame:
    """(shard, content): nodes (id, labels, props) and edges (src, dst, type, props) in documents that stand for themselves.

    An edge lies with its source; props are JSON objects or null.  A document is built where its rows meet; a shard of
    more than ``SHARD_ROWS`` rows has several, dealt by node.
    """
    documents = max(1, -(-(nodes.count() + edges.count()) // (n_shards * SHARD_ROWS)))

    def part(column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(n_shards * documents)).cast("int").alias("part")

    left = nodes.select(part("id"), F.col("id").cast("string").alias("id"), "labels", "props")
    right = edges.select(part("src"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "type", "props")

    def build(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        members = [wire.GraphNode(r.id, list(r.labels), wire.from_json(r.props) if isinstance(r.props, str) else {}) for r in a.sort_values("id").itertuples()]
        links = [wire.GraphEdge(r.src, r.dst, r.type, wire.from_json(r.props) if isinstance(r.props, str) else {}) for r in b.sort_values(["src", "dst"]).itertuples()]
        return pd.DataFrame({"shard": [key[0] % n_shards], "content": [wire.encode(wire.Shard(members, links, dict(meta or {})))]})

    return left.groupBy("part").cogroup(right.groupBy("part")).applyInPandas(build, "shard int, content binary")


def _shard(b) -> wire.Shard | None:
    """The shard in a binary, None where it holds another value; what cannot be read is an error, as its rows would be missed."""
    v = None if b is None else wire.decode(bytes(b))
    return v if isinstance(v, wire.Shard) else None


def shard_counts(content: str | Column) -> Column:
    """struct<nodes,edges,labels> of shards: how many of each, and the distinct labels; null where a value is no shard."""

    def one(b):
        v = _shard(b)
        return (None, None, None) if v is None else (len(v.nodes), len(v.edges), sorted({x for n in v.nodes for x in n.labels}))

    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(b) for b in column], columns=["nodes", "edges", "labels"])

    return F.pandas_udf(run, "struct<nodes:long,edges:long,labels:array<string>>")(content)


def shard_edges(content: str | Column) -> Column:
    """An array of struct<src,dst,type> of the edges of shards; null where a value is no shard."""

    def one(b):
        v = _shard(b)
        return None if v is None else [{"src": e.src, "dst": e.dst, "type": e.type} for e in v.edges]

    def run(column: pd.Series) -> pd.Series:
        return column.map(one)

    return F.pandas_udf(run, "array<struct<src:string,dst:string,type:string>>")(content)


def shard_contents(shards: DataFrame, content: str = "content") -> DataFrame:
    """(nodes, edges, labels, links array<struct<src,dst,type>>) of each shard in a column, read one at a time; other values give no row."""
    fields = "nodes long, edges long, labels array<string>, links array<struct<src:string,dst:string,type:string>>"
    schema = shards.sparkSession.createDataFrame([], fields).schema

    def rows(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        import pyarrow as pa

        target = to_arrow_schema(schema)
        for batch in batches:
            for b in batch.column(0):
                v = _shard(b.as_py())
                if v is not None:
                    ends = pa.StructArray.from_arrays([pa.array([getattr(e, k) for e in v.edges], pa.string()) for k in ("src", "dst", "type")], ["src", "dst", "type"])
                    links = pa.ListArray.from_arrays(pa.array([0, len(v.edges)], pa.int32()), ends)
                    held = [[len(v.nodes)], [len(v.edges)], [sorted({x for n in v.nodes for x in n.labels})]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip(held, target, strict=False)), links.cast(target[3].type)], schema=target)

    return shards.select(content).mapInArrow(rows, schema)
