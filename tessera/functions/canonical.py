"""Canonical text of nested values: equal values have equal text, whatever the order of their members.

Words that need no quotes stand bare, members are sorted by the bytes of their written names, and
numbers take their shortest form.  Lists of three or more like records may be written as tables.
"""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mean something bare, and short escapes.
RESERVED = {"t", "f", "true", "false", "null", "none", "nil"}
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
#: Integers beyond this are written as floats, as JSON readers would take them.
SAFE = (1 << 53) - 1


def word(text: str) -> str:
    """A string bare where that is safe, else in quotes."""
    plain = text.translate(_BARE_SIGNS)
    if text and text not in RESERVED and (text[0] == "_" or text[0].isalpha()) and all(c.isalpha() or c.isdecimal() for c in plain):
        return text
    return '"' + "".join(ESCAPES.get(c) or (c if c >= " " else f"\\u{ord(c):04x}") for c in text) + '"'


_BARE_SIGNS = {ord(c): None for c in "_-./"}


def number(value: float) -> str:
    """Shortest text of a number: whole numbers below a million without a point, powers of ten from there on."""
    if value == 0:
        return "0"
    if math.isinf(value) or math.isnan(value):
        raise ValueError("only finite numbers have a canonical text")
    if value.is_integer() and abs(value) < 1e6:
        return str(int(value))
    sign = "-" if value < 0 else ""
    body, _, shift = repr(abs(value)).partition("e")
    whole, _, fraction = body.partition(".")
    figures = (whole + fraction).lstrip("0")
    power = int(shift or 0) + len(whole) - 1 if whole.strip("0") else int(shift or 0) - (len(fraction) - len(fraction.lstrip("0"))) - 1
    figures = figures.rstrip("0")
    if -4 <= power < 6:
        if power < 0:
            return f"{sign}0.{'0' * (-power - 1)}{figures}"
        return sign + figures[: power + 1].ljust(power + 1, "0") + ("." + figures[power + 1 :] if len(figures) > power + 1 else "")
    rest = "." + figures[1:] if len(figures) > 1 else ""
    return f"{sign}{figures[0]}{rest}e{'-' if power < 0 else '+'}{abs(power):02d}"


def canonical(value, null: str = "_", tables: bool = True, min_rows: int = 3, max_columns: int = 64) -> str:
    """Canonical text of a value made of None, booleans, numbers, strings, lists and dicts."""

    def write(v) -> str:
        if v is None:
            return null
        if isinstance(v, bool):
            return "t" if v else "f"
        if isinstance(v, int):
            return str(v) if abs(v) <= SAFE else number(float(v))
        if isinstance(v, float):
            return number(v)
        if isinstance(v, str):
            return word(v)
        if isinstance(v, dict):
            members = sorted(((word(k), x) for k, x in v.items()), key=lambda m: m[0].encode())
            return "{" + " ".join(f"{k}={write(x)}" for k, x in members) + "}"
        columns = table_columns(v, min_rows, max_columns) if tables else None
        if columns is None:
            return "[" + " ".join(map(write, v)) + "]"
        # fixed value: the header of a table
        lines = [f"@tab _ rows={len(v)} cols={len(columns)} [{' '.join(map(word, columns))}]"]
        lines += ["|" + "|".join((write(row[c]) if c in row else null).replace("|", "\\|") for c in columns) + "|" for row in v]
        return "\n".join([*lines, "@end"])

    return write(value)


def table_columns(rows: list, min_rows: int = 3, max_columns: int = 64) -> list[str] | None:
    """Columns of a list of records that is a table: enough rows, none empty, and half of all names in every row."""
    if len(rows) < min_rows or not all(isinstance(r, dict) and r for r in rows):
        return None
    names = set().union(*rows)
    common = set(rows[0]).intersection(*rows[1:])
    if len(names) > max_columns or 2 * len(common) < len(names):
        return None
    return sorted(names, key=lambda n: word(n).encode())


def of_json(text: str) -> object:
    """JSON text as a value; whole numbers below 2**53 are integers and the last of equal names wins."""

    def real(s: str):
        x = float(s)
        return int(x) if x.is_integer() and abs(x) <= SAFE else x

    return json.loads(text, parse_float=real)


def _canonical_texts(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            return None if t is None else canonical(of_json(t))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def canonical_text(column: str | Column) -> Column:
    """Canonical text of a column of JSON text; null where it is no JSON."""
    return F.pandas_udf(_canonical_texts, "string")(column)


def fingerprint(column: str | Column) -> Column:
    """SHA-256 of the canonical text, as hex digits: equal for equal values."""
    return F.sha2(canonical_text(column), 256)


def state_hash(value) -> str:
    """The hash by which a patch names the state that it applies to."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def schema_context_id(keys: list[str]) -> str:
    """Identity of a list of keys: base32 of five bytes of a SHA-256 over the keys, parted by NUL."""
    import base64

    return base64.b32encode(hashlib.sha256("\0".join(keys).encode()).digest()[:5]).decode().rstrip("=")
