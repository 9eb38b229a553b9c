"""Linked-data documents: terms, a table of IRIs, a table of datatypes, and a value whose references point into them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.sources import wire
from tessera.sources.wire import Decoder, Limits, WireError, varint

# Magic, tags of references, flags of terms, and the namespaces of the vocabulary.
MAGIC = b"SJLD"
IRI_TAG, BLANK_TAG = 0x11, 0x12
LIST, SET, LANGUAGE, INDEX, ID, VOCAB = 1, 2, 4, 8, 16, 32


@dataclass(frozen=True)
class Iri:
    """A reference to a resource."""

    text: str


@dataclass(frozen=True)
class Blank:
    """A resource that has a name in this document alone."""

    name: str


@dataclass
class Linked:
    """A document: terms (term, IRI, flags), and tables of IRIs and datatypes in the order they were first named."""

    terms: list[tuple[str, str, int]] = field(default_factory=list)
    iris: dict[str, int] = field(default_factory=dict)
    datatypes: dict[str, int] = field(default_factory=dict)
    root: object = None
    prefixes: dict[str, str] = field(default_factory=dict)

    def add_prefix(self, prefix: str, namespace: str) -> Linked:
        self.prefixes[prefix] = namespace
        return self

    def full(self, iri: str) -> str:
        """An IRI whose prefix is written out."""
        prefix, colon, rest = iri.partition(":")
        return self.prefixes[prefix] + rest if colon and prefix in self.prefixes else iri

    def add_term(self, term: str, iri: str, flags: int = 0) -> Linked:
        self.terms.append((term, self.full(iri), flags))
        return self

    def add_list_term(self, term: str, iri: str) -> Linked:
        return self.add_term(term, iri, LIST)

    def add_set_term(self, term: str, iri: str) -> Linked:
        return self.add_term(term, iri, SET)

    def add_id_term(self, term: str, iri: str) -> Linked:
        return self.add_term(term, iri, ID)

    def iri(self, text: str) -> Iri:
        """A reference, whose IRI is put into the table."""
        whole = self.full(text)
        self.iris.setdefault(whole, len(self.iris))
        return Iri(whole)

    def literal(self, value, datatype: str = "", lang: str = "") -> dict:
        """A literal with a datatype, which is put into the table, or a language."""
        out = {"@value": value}
        if datatype:
            self.datatypes.setdefault(self.full(datatype), len(self.datatypes))
            out["@type"] = self.datatypes[self.full(datatype)]
        elif lang:
            out["@language"] = lang
        return out


class _Writer(wire.Encoder):
    def __init__(self, doc: Linked, keys: dict[str, int]):
        super().__init__(keys)
        self.doc = doc

    def value(self, v) -> bytes:
        if isinstance(v, Iri):
            return bytes([IRI_TAG]) + varint(self.doc.iris.setdefault(v.text, len(self.doc.iris)))
        if isinstance(v, Blank):
            name = v.name.encode()
            return bytes([BLANK_TAG]) + varint(len(name)) + name
        return super().value(v)


class _Reader(Decoder):
    iris: list[str] = []

    def value(self, depth: int = 0):
        tag = self.data[self.at] if self.at < len(self.data) else -1
        if tag == IRI_TAG:
            self.at += 1
            k = self.varint()
            if k >= len(self.iris):
                raise WireError("ERR_INVALID_FIELD_ID")
            return Iri(self.iris[k])
        if tag == BLANK_TAG:
            self.at += 1
            return Blank(self.text())
        return super().value(depth)


def _listed(names) -> bytes:
    return varint(len(names)) + b"".join(varint(len(n.encode())) + n.encode() for n in names)


def encode_linked(doc: Linked) -> bytes:
    """The document's bytes; references that the root holds join the table."""
    keys: dict[str, int] = {}
    root = _Writer(doc, keys).value(doc.root)
    terms = varint(len(doc.terms)) + b"".join(varint(len(t.encode())) + t.encode() + varint(len(i.encode())) + i.encode() + bytes([f]) for t, i, f in doc.terms)
    return MAGIC + b"\x01\x00" + _listed(keys) + terms + _listed(doc.iris) + _listed(doc.datatypes) + root


def decode_linked(data: bytes, limits: Limits | None = None) -> Linked:
    """The document of a binary."""
    if data[:4] != MAGIC:
        raise WireError("ERR_INVALID_MAGIC")
    if data[4:5] != b"\x01":
        raise WireError("ERR_INVALID_VERSION")
    d = _Reader(data, limits or Limits(), None)
    d.at = 6
    keys = [d.text() for _ in range(d.count())]
    terms = [(d.text(), d.text(), d.take(1)[0]) for _ in range(d.count())]
    d.iris = [d.text() for _ in range(d.count())]
    datatypes = [d.text() for _ in range(d.count())]
    d.keys = keys
    root = d.value()
    if d.at != len(data):
        raise WireError("ERR_TRAILING_DATA")
    return Linked(terms, {x: i for i, x in enumerate(d.iris)}, {x: i for i, x in enumerate(datatypes)}, root)


def jsonable(v):
    """A value in its JSON-LD form."""
    if isinstance(v, Iri):
        return {"@id": v.text}
    if isinstance(v, Blank):
        return {"@id": "_:" + v.name}
    if isinstance(v, list):
        return [jsonable(x) for x in v]
    if isinstance(v, dict):
        return {k: jsonable(x) for k, x in v.items()}
    return wire.jsonable(v)


def of_jsonld(v):
    """JSON-LD with references for objects that are an ``@id`` alone."""
    if isinstance(v, dict):
        if set(v) == {"@id"} and isinstance(v["@id"], str):
            return Blank(v["@id"][2:]) if v["@id"].startswith("_:") else Iri(v["@id"])
        return {k: of_jsonld(x) for k, x in v.items()}
    return [of_jsonld(x) for x in v] if isinstance(v, list) else v


def to_linked(column: str | Column, terms: list[tuple[str, str, int]] = ()) -> Column:
    """JSON-LD text as linked-data documents with the given terms."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else encode_linked(Linked(list(terms), root=of_jsonld(json.loads(t)))))

    return F.pandas_udf(run, "binary")(column)


def linked_fields(column: str | Column) -> Column:
    """struct<root,iris,datatypes,terms> of linked-data documents, ``root`` as JSON-LD text; null where a binary is none."""

    def one(b):
        try:
            d = decode_linked(bytes(b))
        except (WireError, TypeError):
            return None
        terms = [{"term": t, "iri": i, "flags": f} for t, i, f in d.terms]
        return {"root": json.dumps(jsonable(d.root), separators=(",", ":"), ensure_ascii=False), "iris": list(d.iris), "datatypes": list(d.datatypes), "terms": terms}

    kind = "struct<root:string,iris:array<string>,datatypes:array<string>,terms:array<struct<term:string,iri:string,flags:int>>>"

    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(b) or dict.fromkeys(("root", "iris", "datatypes", "terms")) for b in contents], columns=["root", "iris", "datatypes", "terms"])

    return F.pandas_udf(run, kind)(column)
