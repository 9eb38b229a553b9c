"""The read side of the text form, and its typed forms: values, packed records, typed tables, pools, patches.

A document is parsed as a whole in one place; columns of documents go through Arrow-batched functions and
come back as JSON text, which ``parse_json`` turns into VARIANT.  Values without a JSON form follow one
rule each: references are ``^prefix:value``, records ``{"$type", fields}``, tagged values ``{"$tag", "$value"}``.
"""

from __future__ import annotations

import datetime
import functools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.canonical import number, word

#: Nesting beyond which text is refused.
MAX_DEPTH = 128


class TextError(ValueError):
    """Text that is no value, with the place."""

    def __init__(self, message: str, at: int = -1):
        super().__init__(f"{message} at {at}" if at >= 0 else message)
        self.at = at


@dataclass(frozen=True)
class Ref:
    """A reference ``^prefix:value``."""

    prefix: str
    value: str

    def __str__(self) -> str:
        return f"^{self.prefix}:{self.value}" if self.prefix else f"^{self.value}"


@dataclass
class Record:
    """A typed record ``Type{field=value}``."""

    type: str
    fields: dict


@dataclass
class Tagged:
    """A tagged value ``Tag(value)``."""

    tag: str
    value: object


@dataclass(frozen=True)
class Moment:
    """A point in time, as RFC 3339 text in UTC."""

    text: str


class Token(NamedTuple):
    """A lexical unit: kind, text, and place in the input."""

    kind: str
    text: str
    at: int


# Words with a meaning, escapes in quotes.
_WORDS = {"null": None, "none": None, "nil": None, "true": True, "t": True, "false": False, "f": False}
_UNESCAPED = {"n": "\n", "r": "\r", "t": "\t"}

_SKIP = re.compile(r"(?:[ \t\r\n]+|//[^\n]*)*")
_BETWEEN = frozenset(" \t\r\n/")
_STRICT = r"[A-Za-z_][A-Za-z0-9_]*"
_LOOSE = r"[^\W\d][\w\-./]*|_"
_SHAPES = (
    ("string", r'"(?:[^"\\]|\\.)*"'),
    ("ref", r"\^[A-Za-z0-9_:.\-]*"),
    ("null", "∅"),
    ("time", r"\d{4,}-[0-9\-:TZ+.]*"),
    ("float", r"-Inf(?![A-Za-z0-9_])|-?\d+(?:\.\d+(?:[eE][+-]?\d*)?|[eE][+-]?\d*)"),
    ("int", r"-?\d+"),
)
_SIGNS = r"[{}\[\]()=:,|@#<>]"


def _pattern(loose: bool) -> re.Pattern:
    parts = [f"(?P<{k}>{p})" for k, p in _SHAPES] + [f"(?P<name>{_LOOSE if loose else _STRICT})", f"(?P<sign>{_SIGNS})"]
    return re.compile("|".join(parts), re.DOTALL)


_PATTERNS = {loose: _pattern(loose) for loose in (False, True)}


def tokens(text: str, loose: bool = False) -> Iterator[Token]:
    """The lexical units of a text; white space, comments from ``//`` and nothing else stand between them."""
    at, pattern = 0, _PATTERNS[loose]
    while True:
        at = _SKIP.match(text, at).end()
        if at >= len(text):
            return
        found = pattern.match(text, at)
        if found is None:
            raise TextError(f"unexpected character {text[at]!r}", at)
        yield Token(found.lastgroup, found.group(), at)
        at = found.end()


class Parser:
    """Recursive descent over one text.  ``tolerant`` repairs what it can and keeps warnings; ``loose`` reads canonical text."""

    def __init__(self, text: str, tolerant: bool = True, loose: bool = False, names: Callable[[str, str], str] | None = None):
        self.text, self.tolerant, self.loose = text, tolerant, loose
        self.names = names or (lambda _, key: key)
        self.pattern, self.at, self.depth = _PATTERNS[loose], 0, 0
        self.seen, self.next = -1, None  # the token at a place, matched once
        self.warnings: list[str] = []

    def peek(self) -> Token | None:
        if self.at == self.seen:
            return self.next
        text = self.text
        if text[self.at : self.at + 1] in _BETWEEN:
            self.at = _SKIP.match(text, self.at).end()
        if self.at >= len(text):
            return None
        found = self.pattern.match(text, self.at)
        if found is None:
            raise TextError(f"unexpected character {text[self.at]!r}", self.at)
        self.seen, self.next = self.at, Token(found.lastgroup, found.group(), self.at)
        return self.next

    def take(self) -> Token:
        token = self.peek()
        if token is None:
            raise TextError("unexpected end", self.at)
        self.at = token.at + len(token.text)
        return token

    def accept(self, *signs: str) -> bool:
        token = self.peek()
        if token is not None and token.kind == "sign" and token.text in signs:
            self.at = token.at + 1
            return True
        return False

    def wrong(self, message: str) -> None:
        if not self.tolerant:
            raise TextError(message, self.at)
        self.warnings.append(f"{message} at {self.at}")

    def whole(self):
        value = self.value()
        if self.peek() is not None:
            raise TextError("unexpected trailing text", self.at)
        return value

    def value(self):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TextError("nested too deep", self.at)
        try:
            return self._value()
        finally:
            self.depth -= 1

    def _value(self):
        token = self.peek()
        if token is None:
            self.wrong("missing value")
            return None
        if token.kind == "sign":
            if token.text == "[":
                self.take()
                return list(self._items("]", self.value))
            if token.text == "{":
                self.take()
                return dict(m for m in self._items("}", lambda: self._member("")) if m)
            if token.text == "@":
                return self._directive()
            self.take()
            self.wrong(f"unexpected {token.text}")
            return None
        self.take()
        if token.kind == "name":
            return self._named(token.text)
        return self._plain(token)

    def _plain(self, token: Token):
        if token.kind == "string":
            return unquoted(token.text)
        if token.kind == "null":
            return None
        if token.kind == "ref":
            prefix, colon, rest = token.text[1:].partition(":")
            return Ref(prefix, rest) if colon and prefix else Ref("", token.text[1:])
        if token.kind == "int":
            return int(token.text)
        if token.kind == "float":
            return float(token.text.rstrip("+-eE") if token.text != "-Inf" else "-inf")
        return self._moment(token.text)

    def _moment(self, text: str):
        try:
            when = datetime.datetime.fromisoformat(text)
        except ValueError:
            self.wrong(f"no time: {text}")
            return text
        if when.tzinfo is not None:
            when = when.astimezone(datetime.UTC).replace(tzinfo=None)
        return Moment(when.isoformat() + "Z")

    def _named(self, name: str):
        if self.loose and name == "_":
            return None
        following = self.text[self.at : self.at + 1] if self.loose else (self.peek() or Token("", "", 0)).text
        if following == "{":
            self.take()
            return Record(name, dict(m for m in self._items("}", lambda: self._member(name)) if m))
        if following == "(":
            self.take()
            if self.accept(")"):
                return Tagged(name, None)
            held = self.value()
            if not self.accept(")"):
                self.wrong("missing )")
            return Tagged(name, held)
        if name in _WORDS:
            return _WORDS[name]
        if name in ("NaN", "Inf"):
            return float(name.lower())
        if name == "b64" and following.startswith('"'):
            import base64

            return base64.b64decode(unquoted(self.take().text))
        return name

    def _items(self, end: str, read):
        while True:
            token = self.peek()
            if token is None:
                self.wrong(f"missing {end}")
                return
            if token.kind == "sign" and token.text in (end, ","):
                self.take()
                if token.text == end:
                    return
                continue
            yield read()

    def _member(self, owner: str):
        token = self.take()
        if token.kind not in ("name", "string"):
            self.wrong(f"expected a name, got {token.text}")
            return None
        key = unquoted(token.text) if token.kind == "string" else token.text
        if not self.accept("=", ":"):
            self.wrong("expected = or :")
        return self.names(owner, key), self.value()

    def _directive(self):
        rest = self.text[self.at :]
        if rest.startswith("@tab _"):
            stop = re.compile(r"^[ \t]*@end\b", re.MULTILINE).search(rest)
            if stop is None:
                self.wrong("missing @end")
            self.at += stop.end() if stop else len(rest)
            return loose_table(rest[: stop.end()] if stop else rest)
        self.take()
        if (head := self.peek()) and head.text == "schema":
            self.take()
            if self.accept("#"):
                self.take()
            elif self.accept("{"):
                depth = 1
                while depth:
                    sign = self.take().text
                    depth += (sign == "{") - (sign == "}")
        return self.value()


def unquoted(text: str) -> str:
    """The string that a quoted text stands for."""
    if "\\" not in text:
        return text[1:-1]

    def plain(found: re.Match) -> str:
        if found.group(2):
            return chr(int(found.group(2), 16))
        return _UNESCAPED.get(found.group(1), found.group(1))

    return re.sub(r"\\(u([0-9a-fA-F]{4})|.)", plain, text[1:-1], flags=re.DOTALL)


def parse(text: str, tolerant: bool = True, loose: bool = False):
    """The value of a text."""
    return Parser(text, tolerant, loose).whole()


def plain(value):
    """A parsed value in its JSON form."""
    if isinstance(value, (str, int, float)) or value is None:
        return value
    if isinstance(value, Record):
        return {"$type": value.type, **{k: plain(v) for k, v in value.fields.items()}}
    if isinstance(value, Tagged):
        return {"$tag": value.tag, "$value": plain(value.value)}
    if isinstance(value, Ref):
        return str(value)
    if isinstance(value, Moment):
        return value.text
    if isinstance(value, bytes):
        import base64

        return base64.b64encode(value).decode()
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


_COMPACT = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


def _json(value) -> str:
    return _COMPACT(plain(value))


def loose_table(text: str) -> list[dict]:
    """Rows of a table without a type: a header ``@tab _ rows= cols= [names]``, cells between bars, ``@end``."""
    lines = [line.strip() for line in text.split("\n")]
    lines = [line for k, line in enumerate(lines) if line and not line.startswith("#")]
    head = re.match(r"@tab _ (?:[a-z]+=\S* +)*\[([^\]]*)\]", lines[0]) if lines else None
    if head is None:
        raise TextError("expected a header @tab _ [names]")
    names = [unquoted(n) if n.startswith('"') else n for n in re.findall(r'"(?:[^"\\]|\\.)*"|\S+', head.group(1))]
    rows = []
    for line in lines[1:]:
        if line == "@end":
            break
        if not (len(line) > 1 and line.startswith("|") and line.endswith("|")):
            raise TextError(f"a row stands between bars, got {line[:40]}")
        cells = [c.replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line[1:-1])]
        if len(cells) != len(names):
            raise TextError(f"{len(cells)} cells for {len(names)} columns")
        rows.append({n: parse(c, loose=True) if c.strip() else None for n, c in zip(names, cells, strict=True)})
    return rows


# --- typed forms ---


@dataclass
class Field:
    """A field of a record type; ids are counted from 1 where none is given."""

    name: str
    type: str = "str"
    wire: str = ""
    fid: int = 0
    optional: bool = False
    keep_null: bool = False


@dataclass
class RecordType:
    """A record type with its fields."""

    name: str
    fields: list[Field]
    version: str = ""

    def __post_init__(self) -> None:
        used = {f.fid for f in self.fields}
        fresh = (k for k in range(1, len(self.fields) + len(used) + 1) if k not in used)
        for f in self.fields:
            f.fid = f.fid or next(fresh)

    def by_id(self) -> list[Field]:
        return sorted(self.fields, key=lambda f: f.fid)

    def required(self) -> list[Field]:
        return [f for f in self.by_id() if not f.optional]

    def optional(self) -> list[Field]:
        return [f for f in self.by_id() if f.optional]

    def find(self, key: str) -> Field | None:
        """A field by name, wire key or ``#id``."""
        for f in self.fields:
            if key in (f.name, f"#{f.fid}") or (f.wire and key == f.wire):
                return f
        return None


@dataclass
class TypeTable:
    """Record types by name."""

    types: dict[str, RecordType] = field(default_factory=dict)

    def add(self, name: str, *fields: Field, version: str = "") -> TypeTable:
        self.types[name] = RecordType(name, list(fields), version)
        return self

    def field_name(self, owner: str, key: str) -> str:
        found = self.types[owner].find(key) if owner in self.types else None
        return found.name if found else key

    def canonical(self) -> str:
        """One line for each type in order of name: what makes two tables equal."""
        out = []
        for name in sorted(self.types):
            t = self.types[name]
            cells = [f"{f.fid}:{f.name}{'@' + f.wire if f.wire else ''}:{f.type}{'?' if f.optional else ''}" for f in t.by_id()]
            out.append(f"{name}{':' + t.version if t.version else ''}{{{' '.join(cells)}}}")
        return "\n".join(out)

    def identity(self) -> str:
        """SHA-256 of the canonical text, as hex digits."""
        import hashlib

        return hashlib.sha256(self.canonical().encode()).hexdigest()


def parse_types(text: str) -> TypeTable:
    """The table that :meth:`TypeTable.canonical` writes; the text may stand in ``@schema{..}``."""
    inner = re.fullmatch(r"\s*@schema\{(.*)\}\s*", text, re.DOTALL)
    table = TypeTable()
    for line in (inner.group(1) if inner else text).strip().splitlines():
        head = re.fullmatch(r"\s*(\w+)(?::([^{\s]+))?\{([^}]*)\}\s*", line)
        if head is None:
            raise TextError(f"no type: {line[:40]}")
        fields = []
        for part in head.group(3).split():
            found = re.fullmatch(r"(\d+):(\w+)(?:@(\w+))?:([^?\s]+)(\?)?", part)
            if found is None:
                raise TextError(f"no field: {part[:40]}")
            fields.append(Field(found.group(2), found.group(4), found.group(3) or "", int(found.group(1)), bool(found.group(5))))
        table.add(head.group(1), *fields, version=head.group(2) or "")
    return table


def cell(value, null: str = "∅") -> str:
    """A value in packed form."""
    if value is None:
        return null
    if isinstance(value, bool):
        return "t" if value else "f"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return number(value)
    if isinstance(value, str):
        return word(value) if re.fullmatch(_STRICT, value) else '"' + word(value + " ")[1:-2] + '"'
    if isinstance(value, (Ref, Moment)):
        return str(value) if isinstance(value, Ref) else value.text
    if isinstance(value, bytes):
        import base64

        return f'b64"{base64.b64encode(value).decode()}"'
    if isinstance(value, list):
        return "[" + " ".join(cell(v, null) for v in value) + "]"
    if isinstance(value, Tagged):
        return f"{value.tag}({'' if value.value is None else cell(value.value, null)})"
    if isinstance(value, Record):
        return value.type + "{" + " ".join(f"{k}={cell(v, null)}" for k, v in value.fields.items()) + "}"
    return "{" + " ".join(f"{cell(k)}:{cell(v, null)}" for k, v in value.items()) + "}"


def _present(fields: dict, f: Field) -> bool:
    key = f.name if f.name in fields else f.wire
    return key in fields and (fields[key] is not None or not f.optional or f.keep_null)


def _held(fields: dict, f: Field):
    return fields[f.name] if f.name in fields else fields.get(f.wire)


def packed(fields: dict, kind: RecordType, bitmap: bool = True) -> str:
    """``Type@(values)`` in order of field ids, or ``Type@{bm=0b..}(values)`` where optional fields are missing."""
    for f in kind.required():
        if f.name not in fields and f.wire not in fields:
            raise TextError(f"missing required field {kind.name}.{f.name}")
    here = [_present(fields, f) for f in kind.optional()]
    if bitmap and not all(here):
        mask = "".join("1" if x else "0" for x in reversed(here))  # the first optional field is the lowest bit
        given = kind.required() + [f for f, x in zip(kind.optional(), here, strict=True) if x]
        return f"{kind.name}@{{bm=0b{mask}}}({' '.join(cell(_held(fields, f)) for f in given)})"
    return f"{kind.name}@({' '.join(cell(_held(fields, f)) if _present(fields, f) else cell(None) for f in kind.by_id())})"


def parse_packed(text: str, types: TypeTable) -> Record:
    """A record from its packed form; required fields that are missing are an error."""
    head = re.match(r"\s*([A-Za-z_][A-Za-z0-9_]*)@(?:\{\s*bm=0b([01]+)\s*\})?\(", text)
    if head is None:
        raise TextError("expected Type@(")
    if head.group(1) not in types.types:
        raise TextError(f"unknown type {head.group(1)}")
    kind = types.types[head.group(1)]
    parser = Parser(text, tolerant=False, names=types.field_name)
    parser.at = head.end()
    values = list(parser._items(")", parser.value))
    if parser.peek() is not None:
        raise TextError("unexpected trailing text", parser.at)
    order = kind.by_id()
    if head.group(2) is not None:
        bits = head.group(2)[::-1]
        order = kind.required() + [f for f, b in zip(kind.optional(), bits, strict=False) if b == "1"]
    if len(values) > len(order):
        raise TextError("more values than fields")
    given = dict(zip((f.name for f in order), values, strict=False))
    for f in kind.required():
        if f.name not in given:
            raise TextError(f"missing required field {f.name}")
    return Record(kind.name, {f.name: given.get(f.name) for f in kind.by_id()})


def typed_table(rows: list[dict], kind: RecordType, keys: str = "wire", inline: bool = False) -> str:
    """Rows of one type as a table: a header with column names, wire keys or ids, cells parted by spaces, ``@end``."""
    shown = {"wire": lambda f: f.wire or f.name, "name": lambda f: f.name, "fid": lambda f: f"#{f.fid}"}[keys]
    lines = []
    for row in rows:
        for f in kind.required():
            if _held(row, f) is None:
                raise TextError(f"missing required field {f.name}")
        lines.append(" ".join(cell(_held(row, f)) for f in kind.by_id()))
    head = f"@tab {kind.name} [{' '.join(shown(f) for f in kind.by_id())}]"
    return f"{head} {' | '.join(lines)} @end" if inline else "\n".join([head, *lines, "@end"])


def parse_table(text: str, types: TypeTable) -> list[Record]:
    """Rows of a typed table, over lines or inline; a missing required cell, an extra one or a missing ``@end`` is an error."""
    head = re.match(r"\s*@tab ([A-Za-z_]\w*) \[([^\]]*)\]", text)
    if head is None or head.group(1) not in types.types:
        raise TextError("expected a header @tab Type [names] of a known type")
    kind = types.types[head.group(1)]
    columns = [kind.find(name) for name in head.group(2).split()]
    if None in columns:
        raise TextError("unknown column")
    body = text[head.end() :]
    end = re.search(r"(?:^|\s)@end\s*$", body)
    if end is None:
        raise TextError("missing @end")
    body = body[: end.start()]
    rows, inline = [], not body.startswith("\n")
    parser = Parser(body, tolerant=False, names=types.field_name)
    while parser.peek() is not None:
        line = body.count("\n", 0, parser.at)
        values = []
        while (token := parser.peek()) is not None and (inline or body.count("\n", 0, parser.at) == line):
            if inline and token.text == "|":
                parser.take()
                break
            values.append(parser.value())
        if len(values) > len(columns):
            raise TextError("more cells than columns")
        given = {f.name: v for f, v in zip(columns, values, strict=False)}
        for f in kind.required():
            if given.get(f.name) is None:
                raise TextError(f"missing required field {f.name}")
        rows.append(Record(kind.name, {f.name: given.get(f.name) for f in kind.by_id()}))
    return rows


# --- headers, modes, blobs ---

MODES = ("auto", "struct", "packed", "tabular", "patch")


@dataclass
class Header:
    """The first line of a document: version, schema, mode, kind of keys, target."""

    version: str = "v2"
    schema: str = ""
    mode: str = "auto"
    keys: str = "wire"
    target: str = ""


def parse_header(line: str) -> Header | None:
    """A header ``@word version @schema#id @mode=.. @keys=.. @target=..``, whatever its first word; None where there is none."""
    parts = re.findall(r'(?:"[^"]*"|[^ "])+', line.strip())
    if not parts or not re.fullmatch(r"@[a-z]+", parts[0]) or parts[0] in ("@tab", "@patch", "@schema", "@frame", "@blob"):
        return None
    head = Header()
    if len(parts) > 1 and not parts[1].startswith("@"):
        head.version = parts[1]
    for part in parts[1:]:
        if part.startswith("@schema#"):
            head.schema = part[8:]
        elif part.startswith("@mode="):
            head.mode = {"tab": "tabular"}.get(part[6:], part[6:])
            if head.mode not in MODES:
                raise TextError(f"unknown mode {head.mode}")
        elif part.startswith("@keys="):
            head.keys = part[6:]
            if head.keys not in ("wire", "name", "fid"):
                raise TextError(f"unknown keys {head.keys}")
        elif part.startswith("@target="):
            head.target = part[8:]
        elif part in ("@patch", "@tab"):
            head.mode = "patch" if part == "@patch" else "tabular"
    return head


def emit_header(head: Header, first: str = "@doc") -> str:
    """The line that :func:`parse_header` reads."""
    parts = [first, head.version]
    parts += [f"@schema#{head.schema}"] if head.schema else []
    parts += [f"@mode={head.mode}"] if head.mode != "auto" else []
    parts += [f"@keys={head.keys}"] if head.keys != "wire" else []
    parts += [f"@target={head.target}"] if head.target else []
    return " ".join(parts)


def detect_mode(text: Column) -> Column:
    """patch, tabular, packed or struct, by how a text begins."""
    start = F.ltrim(text)
    return (
        F.when(start.startswith("@patch") | start.contains("@mode=patch"), "patch")
        .when(start.startswith("@tab"), "tabular")
        .when(start.rlike(r"^[A-Za-z_][A-Za-z0-9_]*@[({]"), "packed")
        .otherwise("struct")
    )


def select_mode(n_rows: Column, one_type: Column, packable: Column, threshold: int = 3) -> Column:
    """The mode to write in: a table for ``threshold`` rows of one type, else packed where the type allows it."""
    return F.when((n_rows >= threshold) & one_type, "tabular").when(packable, "packed").otherwise("struct")


def blob_text(cid: Column, mime: Column, size: Column, name: Column | None = None) -> Column:
    """``@blob cid=.. mime=.. bytes=.. [name=".."]``."""
    parts = [F.concat(F.lit("@blob cid="), cid), F.concat(F.lit("mime="), mime), F.concat(F.lit("bytes="), size.cast("string"))]
    if name is not None:
        parts.append(F.concat(F.lit('name="'), F.regexp_replace(name, r'(["\\])', r"\\$1"), F.lit('"')))
    return F.concat_ws(" ", *parts)


def blob_fields(text: Column) -> Column:
    """struct<cid,mime,bytes,name> of a blob reference; null where cid or mime is missing."""

    def of(key: str) -> Column:
        bare = F.regexp_extract(text, rf"[ ]{key}=([^ \t\n\"]+)", 1)
        quoted = F.regexp_replace(F.regexp_extract(text, rf"[ ]{key}=\"((?:[^\"\\\\]|\\\\.)*)\"", 1), r"\\(.)", "$1")
        return F.when(quoted != "", quoted).when(bare != "", bare)

    whole = F.struct(of("cid").alias("cid"), of("mime").alias("mime"), of("bytes").cast("long").alias("bytes"), of("name").alias("name"))
    return F.when(text.startswith("@blob ") & of("cid").isNotNull() & of("mime").isNotNull(), whole)


# --- pools and documents ---


def is_pool_ref(ref: Ref) -> bool:
    """Capital letters and then a digit name a pool."""
    return bool(re.match(r"[A-Z]+\d", ref.prefix)) and ref.value.isdigit()


def emit_pool(name: str, entries: list, kind: str = "str") -> str:
    """``@pool.str id=S1 [entries]``."""
    return f"@pool.{kind} id={name} [{' '.join(cell(e) for e in entries)}]"


def parse_pool(text: str) -> tuple[str, list]:
    """(name, entries) of a pool."""
    head = re.match(r"@pool\.(str|obj) id=([^\s\[]+)\s*(?=\[)", text)
    if head is None:
        raise TextError("expected @pool.str or @pool.obj with id= and entries")
    entries = Parser(text[head.end() :], tolerant=False).whole()
    if head.group(1) == "str" and not all(isinstance(e, str) for e in entries):
        raise TextError("a pool of strings holds strings")
    return head.group(2), entries


@functools.lru_cache(256)
def _pool_line(line: str) -> tuple[str, list] | None:
    """The pool of strings that a whole line is, None where it is none or goes on; many documents begin with the same."""
    try:
        name, entries = parse_pool(line)
    except (TextError, ValueError):
        return None
    return (name, entries) if all(isinstance(e, str) for e in entries) else None


def resolved(value, pools: dict[str, list]):
    """A value with the entries that its pool references stand for; an unknown pool or slot is an error."""
    if isinstance(value, Ref) and is_pool_ref(value):
        if value.prefix not in pools or int(value.value) >= len(pools[value.prefix]):
            raise TextError(f"no pool entry {value}")
        return pools[value.prefix][int(value.value)]
    if isinstance(value, list):
        return [resolved(v, pools) for v in value]
    if isinstance(value, dict):
        return {k: resolved(v, pools) for k, v in value.items()}
    if isinstance(value, Record):
        return Record(value.type, resolved(value.fields, pools))
    if isinstance(value, Tagged):
        return Tagged(value.tag, resolved(value.value, pools))
    return value


def parse_document(text: str, pools: dict[str, list] | None = None):
    """Pool blocks, a schema line, then one value whose pool references are resolved."""
    pools, rest = dict(pools or {}), []
    at = 0
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop].strip()
        if line.startswith("@pool.") and (pool := _pool_line(line)) is not None:
            pools[pool[0]] = list(pool[1])
        elif line.startswith("@pool."):
            end = Parser(text, tolerant=False)
            end.at = text.index("[", at)
            end.value()
            name, entries = parse_pool(text[at : end.at].strip())
            pools[name] = entries
            stop = end.at
        elif line and not (line.startswith("@schema") and not rest):
            rest.append(text[at:stop])
        at = stop + 1
    if not rest:
        raise TextError("no value")
    value = parse("\n".join(rest), loose=True)
    return resolved(value, pools) if "^" in text else value


# --- patches ---


@dataclass(frozen=True)
class Change:
    """An operation of a patch: ``=`` set, ``+`` append, ``-`` delete, ``~`` add a number."""

    op: str
    path: str
    value: object = None
    index: int = -1


@dataclass
class Patch:
    """Operations on a target, built one after another."""

    target: str = ""
    schema: str = ""
    base: str = ""
    keys: str = "wire"
    ops: list[Change] = field(default_factory=list)

    def set(self, path: str, value) -> Patch:
        self.ops.append(Change("=", path, value))
        return self

    def append(self, path: str, value) -> Patch:
        self.ops.append(Change("+", path, value))
        return self

    def insert_at(self, path: str, index: int, value) -> Patch:
        self.ops.append(Change("+", path, value, index))
        return self

    def delete(self, path: str) -> Patch:
        self.ops.append(Change("-", path))
        return self

    def delta(self, path: str, amount: float) -> Patch:
        self.ops.append(Change("~", path, amount))
        return self

    def text(self, in_order: bool = True) -> str:
        """``@patch`` with its attributes, one operation a line, ``@end``; operations sorted by path where ``in_order``."""
        head = "@patch" + (f" @schema#{self.schema}" if self.schema else "") + f" @keys={self.keys} @target={self.target}"
        head += f" @base={self.base}" if self.base else ""
        ops = sorted(self.ops, key=lambda o: (o.path, o.op)) if in_order else self.ops
        lines = []
        for o in ops:
            line = f"{o.op} {o.path}"
            if o.op == "~":
                line += f" {'+' if o.value >= 0 else ''}{cell(o.value)}"
            elif o.op != "-":
                line += f" {cell(o.value)}" + (f" @idx={o.index}" if o.index >= 0 else "")
            lines.append(line)
        return "\n".join([head, *lines, "@end"])


_PATH = r'(?:#?\w+|"(?:[^"\\]|\\.)*")(?:\.#?\w+|\."(?:[^"\\]|\\.)*"|\[\d+\]|\["[^"]*"\])*'


_OPERATION = re.compile(rf"([=+~\-])\s+({_PATH})\s*(.*)$")


def parse_patch(text: str) -> Patch:
    """The patch of a text."""
    lines = [line.strip() for line in text.strip().split("\n")]
    if not lines[0].startswith("@patch") or lines[-1] != "@end":
        raise TextError("a patch stands between @patch and @end")
    patch = Patch()
    for part in lines[0].split()[1:]:
        name, _, held = part.partition("#" if part.startswith("@schema#") else "=")
        if name in ("@schema", "@keys", "@target", "@base"):
            setattr(patch, name[1:], held)
    for line in lines[1:-1]:
        if not line:
            continue
        found = _OPERATION.match(line)
        if found is None:
            raise TextError(f"no operation: {line[:40]}")
        op, path, rest = found.groups()
        index = -1
        if op == "+" and (at := re.search(r" @idx=(\d+)$", rest)):
            rest, index = rest[: at.start()], int(at.group(1))
        value = None if op == "-" else parse(rest.lstrip("+") if op == "~" else rest, tolerant=False)
        patch.ops.append(Change(op, path, value, index))
    return patch


def path_steps(path: str) -> list[str | int]:
    """The members and indexes of a path."""
    return list(_steps(path))


@functools.lru_cache(1024)
def _steps(path: str) -> tuple[str | int, ...]:
    steps: list[str | int] = []
    for name, quoted, index, key in re.findall(r'(#?\w+)(?=[.\[]|$)|("(?:[^"\\]|\\.)*")(?=[.\[]|$)|\[(\d+)\]|\["([^"]*)"\]', path.replace(".", ".")):
        steps.append(int(index) if index else key or (unquoted(quoted) if quoted else name))
    return tuple(steps)


def applied(value, patch: Patch):
    """``value`` (dicts and lists) after a patch; a number added to an integer stays one."""
    value = json.loads(json.dumps(plain(value)))
    for o in patch.ops:
        *way, last = path_steps(o.path)
        held = value
        for step in way:
            if isinstance(held, dict):
                held = held.setdefault(step, {})
            else:
                held = held[step]
        new = plain(o.value)
        if o.op == "=":
            held[last] = new
        elif o.op == "-":
            held.pop(last, None) if isinstance(held, dict) else held.pop(last)
        elif o.op == "~":
            before = held.get(last, 0) if isinstance(held, dict) else held[last]
            held[last] = type(before)(before + new) if isinstance(before, int) else before + new
        else:
            items = held.setdefault(last, []) if isinstance(held, dict) else held[last]
            if not isinstance(items, list):
                raise TextError(f"{o.path} is no list")
            items.insert(o.index if o.index >= 0 else len(items), new)
    return value


def difference(before, after, path: str = "") -> list[Change]:
    """Operations that turn one nested value into another: objects by member, lists as a whole."""
    if isinstance(before, dict) and isinstance(after, dict):
        out = []
        for key in sorted({*before, *after}):
            step = key if re.fullmatch(r"\w+", key) else json.dumps(key)
            where = f"{path}.{step}" if path else step
            if key not in after:
                out.append(Change("-", where))
            elif key not in before:
                out.append(Change("=", where, after[key]))
            else:
                out += difference(before[key], after[key], where)
        return out
    same = type(before) is type(after) and before == after
    return [] if same else [Change("=", path, after)]


# --- columns ---


def _each(function: Callable, catch=(ValueError, IndexError, KeyError, TypeError)) -> Callable[[pd.Series], pd.Series]:
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else function(t)
            except catch:
                return None

        return texts.map(one)

    return run


def text_to_json(column: str | Column, loose: bool = True) -> Column:
    """Text documents, with pools or tables, as JSON text; null where a text is none."""
    if loose:
        return F.pandas_udf(_each(lambda t: _json(parse_document(t))), "string")(column)
    return F.pandas_udf(_each(lambda t: _json(parse(t))), "string")(column)


def packed_text(column: str | Column, kind: RecordType) -> Column:
    """JSON objects in packed form."""
    return F.pandas_udf(_each(lambda t: packed(json.loads(t), kind)), "string")(column)


def packed_to_json(column: str | Column, types: TypeTable) -> Column:
    """Packed records as JSON text."""
    return F.pandas_udf(_each(lambda t: _json(parse_packed(t, types).fields)), "string")(column)


def table_rows(column: str | Column, types: TypeTable) -> Column:
    """An array of JSON texts, one for each row of a typed table."""
    return F.pandas_udf(_each(lambda t: [_json(r.fields) for r in parse_table(t, types)]), "array<string>")(column)


def loose_table_rows(column: str | Column) -> Column:
    """An array of JSON texts, one for each row of a table without a type."""
    return F.pandas_udf(_each(lambda t: [_json(r) for r in loose_table(t)]), "array<string>")(column)


def patch_ops(column: str | Column) -> Column:
    """An array of struct<op,path,value,index> of patch texts, values as JSON text."""

    def ops(t: str) -> list[dict]:
        return [{"op": o.op, "path": o.path, "value": None if o.op == "-" else _json(o.value), "index": o.index} for o in parse_patch(t).ops]

    def run(texts: pd.Series) -> pd.Series:
        return _each(ops)(texts)

    return F.pandas_udf(run, "array<struct<op:string,path:string,value:string,index:int>>")(column)


def difference_text(before: Column, after: Column) -> Column:
    """The patch text that turns one column of JSON text into another."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else Patch(ops=difference(json.loads(x), json.loads(y))).text() for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(before, after)


def patched_json(value: Column, patch: Column) -> Column:
    """JSON text after a patch text."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _json(applied(json.loads(x), parse_patch(y))) for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(value, patch)
