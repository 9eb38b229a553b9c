"""Validation of token streams that call tools: ``name{key=value key="text"}``, token by token.

The tool's name is known as soon as its brace opens, so a call that is not allowed stops early.  Fields
are checked when they end, and all of them once more when the call closes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Argument:
    """What an argument must satisfy."""

    type: str = "string"
    required: bool = False
    minimum: float | None = None
    maximum: float | None = None
    min_len: int | None = None
    max_len: int | None = None
    pattern: str | None = None
    enum: tuple[str, ...] | None = None

    def errors(self, name: str, value: str) -> list[str]:
        found = []
        if self.type in ("int", "float"):
            try:
                number = int(value) if self.type == "int" else float(value)
            except ValueError:
                return [f"type:{name}"]
            if self.minimum is not None and number < self.minimum:
                found.append(f"min:{name}")
            if self.maximum is not None and number > self.maximum:
                found.append(f"max:{name}")
        size = len(value.encode())
        if self.min_len is not None and size < self.min_len:
            found.append(f"min_len:{name}")
        if self.max_len is not None and size > self.max_len:
            found.append(f"max_len:{name}")
        if self.pattern is not None and not re.search(self.pattern, value):
            found.append(f"pattern:{name}")
        if self.enum is not None and value not in self.enum:
            found.append(f"enum:{name}")
        return found


@dataclass
class Validator:
    """The state of one stream."""

    tools: dict[str, dict[str, Argument]]
    max_fields: int = 1000
    max_errors: int = 100
    tool: str | None = None
    fields: dict[str, str] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    done: bool = False
    _held: str = ""
    _key: str | None = None
    _quoted: bool = False
    _escaped: bool = False

    @property
    def should_stop(self) -> bool:
        return self.done or len(self.errors) >= self.max_errors or (self.tool is not None and self.tool not in self.tools)

    def push(self, token: str) -> None:
        for c in token:
            if self.should_stop:
                return
            self._char(c)

    def _char(self, c: str) -> None:
        if self.tool is None:
            if c == "{":
                self.tool, self._held = self._held.strip(), ""
                if self.tool not in self.tools:
                    self.errors.append(f"unknown_tool:{self.tool}")
            else:
                self._held += c
        elif self._quoted:
            if self._escaped:
                self._held, self._escaped = self._held + {"n": "\n", "t": "\t"}.get(c, c), False
            elif c == "\\":
                self._escaped = True
            elif c == '"':
                self._quoted = False
                self._end()
            else:
                self._held += c
        elif c == '"' and self._key is not None and not self._held:
            self._quoted = True
        elif c == "=" and self._key is None:
            self._key, self._held = self._held.strip(), ""
        elif c in " ,\n\t}":
            self._end()
            if c == "}":
                self._close()
        else:
            self._held += c

    def _end(self) -> None:
        if self._key is not None:
            if len(self.fields) >= self.max_fields:
                self.errors.append("too_many_fields")
            else:
                self.fields[self._key] = self._held
                rule = self.tools[self.tool].get(self._key)
                self.errors += [f"unknown_field:{self._key}"] if rule is None else rule.errors(self._key, self._held)
        self._key, self._held = None, ""

    def _close(self) -> None:
        self.errors += [f"required:{k}" for k, a in self.tools[self.tool].items() if a.required and k not in self.fields]
        self.done = True


RESULT = "stream_id long, tool string, n_fields long, valid boolean, complete boolean, errors array<string>"


def validate_streams(tokens: DataFrame, tools: dict[str, dict[str, Argument]]) -> DataFrame:
    """One row for each stream of (stream_id, pos, token): its tool, and what is wrong with the call.

    A stream's tokens are folded in order of ``pos``; the state is bounded by the limits, not by the stream.
    """
    ordered = tokens.select("stream_id", "pos", "token").repartition("stream_id").sortWithinPartitions("stream_id", "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, out = None, None, []

        def row():
            return (current, state.tool, len(state.fields), state.done and not state.errors, state.done, state.errors)

        columns = ["stream_id", "tool", "n_fields", "valid", "complete", "errors"]
        for batch in batches:
            for stream, token in zip(batch.stream_id, batch.token, strict=True):
                if stream != current:
                    if state is not None:
                        out.append(row())
                    current, state = stream, Validator(tools)
                if isinstance(token, str):
                    state.push(token)
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if state is not None:
            out.append(row())
        if out:
            yield pd.DataFrame(out, columns=columns)

    return ordered.mapInPandas(run, RESULT)
