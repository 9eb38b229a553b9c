"""Parsing text that arrives in pieces: events with their paths, and the state of each stream between pieces.

A piece may end anywhere, in a word or in a string: what is not whole yet waits for the next piece.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.textcodec import TextError, parse, plain, unquoted
from tessera.operators.ranks import ranked

#: Limits on nesting, on the bytes of a name and of a value.
MAX_DEPTH, MAX_NAME, MAX_VALUE = 128, 4096, 1 << 20

_SKIP = re.compile(r"[ \t\r\n,]*")
_UNIT = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]()]|[=:]|[^\s{}\[\]()=:,"]+', re.DOTALL)


@dataclass
class Incremental:
    """A parser that is fed pieces: ``stack`` holds (kind, name or index) of what is open, ``held`` text that is not whole."""

    stack: list[list] = field(default_factory=list)
    held: str = ""
    name: str | None = None
    begun: bool = False
    error: str = ""

    def _path(self) -> str:
        steps = [str(f[1]) for f in self.stack if f[1] is not None]
        return ".".join(steps)

    def _place(self) -> None:
        """Step to the next index of an open list, or to the name just read."""
        if not self.stack:
            return
        top = self.stack[-1]
        if top[0] == "list":
            top[1] = 0 if top[1] is None else top[1] + 1
        elif top[0] == "object":
            if self.name is None:
                raise TextError("a value without a name")
            top[1], self.name = self.name, None

    def feed(self, piece: str, last: bool = False) -> Iterator[tuple[str, str, str | None]]:
        """(event, path, value) of all that the piece completes; ``need_more`` where something waits."""
        if self.error:
            return
        text, at = self.held + piece, 0
        try:
            while True:
                at = _SKIP.match(text, at).end()
                unit = _UNIT.match(text, at)
                if unit is None:
                    if at < len(text) and (last or len(text) - at > MAX_VALUE):
                        raise TextError("text that is no value")
                    break
                word = unit.group()
                if unit.end() == len(text) and not last and word not in ("{", "}", "[", "]", "(", ")", "=", ":") and not word.startswith('"'):
                    break  # a bare word may go on
                follows = _SKIP.match(text, unit.end()).end()
                if follows == len(text) and not last and word not in ("{", "}", "[", "]", "(", ")", "=", ":"):
                    break  # what follows tells names, types and values apart
                yield from self._unit(word, text[follows : follows + 1])
                at = unit.end()
            self.held = text[at:]
            if last and (self.stack or self.held.strip()):
                raise TextError("unexpected end")
            if self.held and not last:
                yield "need_more", self._path(), None
        except TextError as e:
            self.error = str(e)
            yield "error", self._path(), self.error

    def _unit(self, word: str, follows: str) -> Iterator[tuple[str, str, str | None]]:
        in_object = bool(self.stack) and self.stack[-1][0] == "object"
        if word in ("=", ":"):
            if self.name is None:
                raise TextError("a sign without a name")
            return
        if word in ("{", "[", "("):
            kind = {"{": "object", "[": "list", "(": "sum"}[word]
            type_name = getattr(self, "_type", None)
            self._type = None
            if type_name is None:
                self._place()
            if len(self.stack) >= MAX_DEPTH:
                raise TextError("nested too deep")
            yield f"start_{kind}", self._path(), type_name
            self.stack.append([kind, None])
            self.begun = True
            return
        if word in ("}", "]", ")"):
            kind = {"}": "object", "]": "list", ")": "sum"}[word]
            if not self.stack or self.stack[-1][0] != kind:
                raise TextError(f"unexpected {word}")
            self.stack.pop()
            yield f"end_{kind}", self._path(), None
            return
        if in_object and self.name is None:
            if follows not in ("=", ":"):
                raise TextError("expected = or :")
            name = unquoted(word) if word.startswith('"') else word
            if len(name.encode()) > MAX_NAME:
                raise TextError("name too long")
            self.name = name
            yield "key", self._path_to(name), name
            return
        if follows in ("{", "(") and not word.startswith('"'):
            self._place()
            self._type = word
            return
        if len(word.encode()) > MAX_VALUE:
            raise TextError("value too long")
        if not self.stack and self.begun:
            raise TextError("text after the value")
        self._place()
        self.begun = True
        yield "value", self._path(), json.dumps(plain(parse(word)), ensure_ascii=False)

    def _path_to(self, name: str) -> str:
        steps = [str(f[1]) for f in self.stack[:-1] if f[1] is not None]
        return ".".join([*steps, name])

    def state(self) -> str:
        return json.dumps([self.stack, self.held, self.name, self.begun, self.error, getattr(self, "_type", None)])

    @staticmethod
    def of(state: str) -> Incremental:
        stack, held, name, begun, error, type_name = json.loads(state)
        out = Incremental(stack, held, name, begun, error)
        out._type = type_name
        return out


EVENTS = "sid long, seq long, event string, path string, value string"


#: Groups that streams are dealt to: one call and one state hold the parsers of a group's streams.
STREAM_GROUPS = 4096


def _update(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    parsers = json.loads(state.get[0]) if state.exists else {}
    rows, now, parser = [], None, Incremental()
    whole = pd.concat(list(pieces), ignore_index=True).sort_values(["sid", "seq"], kind="stable")
    for sid, seq, text, last in zip(*(whole[c].tolist() for c in ("sid", "seq", "piece", "last")), strict=True):
        if sid != now:
            if now is not None:
                parsers[str(now)] = parser.state()
            now, known = sid, parsers.get(str(sid))
            parser = Incremental() if known is None else Incremental.of(known)
        rows += [(sid, seq, *event) for event in parser.feed(text or "", bool(last))]
    if now is not None:
        parsers[str(now)] = parser.state()
    state.update((json.dumps(parsers),))
    yield pd.DataFrame(rows, columns=["sid", "seq", "event", "path", "value"])


def parse_events(pieces: DataFrame) -> DataFrame:
    """(sid, seq, event, path, value) of streams of pieces (sid, seq, piece, last), with the parsers of a group of streams as its state.

    Pieces of a stream must come in the order of ``seq`` over micro-batches; within one they are sorted, which holds a
    group's part of the micro-batch in one task: bound it by the source's rows or files a trigger.
    """
    group = F.pmod(F.xxhash64(F.col("sid").cast("long")), F.lit(STREAM_GROUPS)).alias("group")
    given = pieces.select(group, F.col("sid").cast("long").alias("sid"), F.col("seq").cast("long").alias("seq"), "piece", "last")
    return given.groupBy("group").applyInPandasWithState(_update, EVENTS, "parsers string", "append", GroupStateTimeout.NoTimeout)


# --- change feeds ---

CHANGES = "id string, seq long, op string, changed boolean, props string"


def _change(key: tuple, events: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, alive, props = state.get if state.exists else (-1, False, None)
    rows = []
    whole = pd.concat(list(events), ignore_index=True).sort_values("seq", kind="stable")
    for seq, op, new in whole[["seq", "op", "props"]].itertuples(index=False):
        seq, new = int(seq), new if isinstance(new, str) else None
        if seq <= at:  # late or repeated
            rows.append((key[0], seq, op, False, props if alive else None))
            continue
        keeps = op != "delete"
        differs = keeps != alive or (keeps and new != props)
        at, alive, props = seq, keeps, new if keeps else None
        rows.append((key[0], seq, op, bool(differs), props))
    state.update((int(at), bool(alive), props))
    yield pd.DataFrame(rows, columns=["id", "seq", "op", "changed", "props"])


def change_feed(events: DataFrame) -> DataFrame:
    """(id, seq, op, changed, props): upserts and deletes (id, seq, op, props) against the latest state of each id.

    ``changed`` tells whether the state differs after the event; late and repeated events change nothing.
    """
    given = events.select(F.col("id").cast("string").alias("id"), "seq", "op", "props")
    return given.groupBy("id").applyInPandasWithState(_change, CHANGES, "at long, alive boolean, props string", "append", GroupStateTimeout.NoTimeout)


def batches_of(events: DataFrame, kind: str, order: str, size: int = 1000) -> DataFrame:
    """Add ``batch``: events are written in batches of ``size`` of one kind, in their order.

    The rank within a kind is a prefix sum over ranges, so no task holds a kind.
    """
    placed = ranked(events, [kind, order], "_rank")
    first = placed.groupBy(kind).agg(F.min("_rank").alias("_first"))
    return placed.join(F.broadcast(first), kind).withColumn("batch", F.floor((F.col("_rank") - F.col("_first")) / size)).drop("_rank", "_first")


def write_graph(events: DataFrame, writer, kind: str = "kind", order: str = "seq") -> int:
    """Replay a change log into a writer: an object with ``nodes``, ``edges`` and ``triples``, functions of a DataFrame of their kind.

    Nodes come first, then edges, then triples, as a store needs them; returns the kinds that were written.
    """
    written = 0
    for name, write in (("node", writer.nodes), ("edge", writer.edges), ("triple", writer.triples)):
        part = events.where(F.col(kind) == name)
        if not part.isEmpty():
            write(part.orderBy(order))
            written += 1
    return written
