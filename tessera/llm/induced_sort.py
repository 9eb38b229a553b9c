"""Suffix and common-prefix arrays by external induced sorting.

Suffixes of type S that follow one of type L are sorted first, by recursion on the string of their
names; the order of all other suffixes is induced from theirs.  Inducing takes suffixes in order from
priority queues keyed by (first symbol, rank of the rest).  Ranks arrive in order, so a queue is a
first-in-first-out list for each symbol: blocks of (position, common prefix) that go to disk when they
exceed the memory allowed.  Common prefixes are carried along: two suffixes induced in turn share one
symbol more than the least common prefix between the suffixes that induced them.

Texts are bytes in which 0xFF, that no UTF-8 text holds, parts the pieces.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Common prefixes are counted up to this, over the 100 bytes that matter.
CAP = 200
#: Reduced strings of so many symbols are sorted in memory.
IN_MEMORY = 1 << 21
#: Bytes of queues held in memory before blocks go to disk.
QUEUE_BYTES = 64 << 20
_BLOCK = 1 << 16


class Queues:
    """First-in-first-out blocks of (position, common prefix) for each symbol, backed by a file."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.held, self.file = folder, limit, 0, None
        self.blocks: dict[int, list] = {}

    def push(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        size = positions.nbytes + prefixes.nbytes
        if self.held + size > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=self.folder)
            at = self.file.seek(0, os.SEEK_END)
            self.file.write(positions.tobytes())
            self.file.write(prefixes.tobytes())
            self.blocks.setdefault(symbol, []).append((at, len(positions)))
        else:
            self.held += size
            self.blocks.setdefault(symbol, []).append((positions, prefixes))

    def read(self, block) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(block[0], np.ndarray):
            return block
        at, n = block
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), dtype=np.int64), np.frombuffer(self.file.read(n), dtype=np.uint8)

    def batch(self, symbol: int, at: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The blocks of a symbol from ``at`` on, joined up to a block's size, and where the next one begins."""
        held, n, blocks = [], 0, self.blocks[symbol]
        while at < len(blocks) and n < _BLOCK:
            held.append(self.read(blocks[at]))
            n, at = n + len(held[-1][0]), at + 1
        if len(held) == 1:
            return *held[0], at
        return np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), at

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(text: np.ndarray) -> np.ndarray:
    """True for suffixes of type S: less than the suffix after them.  The empty suffix, the least, is S."""
    n = len(text)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    step[-1] = -1  # before the empty suffix
    known = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(known[::-1])[::-1]
    return np.append(step[following] > 0, True)


def _runs(text: np.ndarray) -> np.ndarray:
    """How often the symbol of each place repeats from there on, up to CAP."""
    n = len(text)
    edge = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, n)
    at = np.arange(n)
    return np.minimum(edge[np.searchsorted(edge, at, side="right")] - at, CAP).astype(np.uint8)


class _Pass:
    """One inducing pass: pushes the predecessors of one type of the suffixes it is given in order."""

    def __init__(self, text, kind, queues, n_symbols):
        self.text, self.kind, self.queues = text, kind, queues
        self.pending = np.full(n_symbols, 255, dtype=np.uint8)  # least prefix since the last push for a symbol

    def take(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        for a in range(0, len(positions), _BLOCK):
            self._take(positions[a : a + _BLOCK], prefixes[a : a + _BLOCK])

    def _take(self, positions, prefixes):
        before = positions - 1
        chosen = np.flatnonzero((before >= 0) & self.kind[before])
        least = prefixes.min() if len(prefixes) else 255
        if not len(chosen):
            np.minimum(self.pending, least, out=self.pending)
            return
        before = before[chosen]
        symbols = self.text[before]
        order = np.argsort(symbols, kind="stable")
        symbols, before, chosen = symbols[order], before[order], chosen[order]
        first = np.ones(len(symbols), dtype=bool)
        first[1:] = symbols[1:] != symbols[:-1]
        low = np.zeros(len(symbols), dtype=np.int64)
        low[1:] = np.where(first[1:], 0, chosen[:-1] + 1)
        shared = _range_min(prefixes, low, chosen)
        shared[first] = np.minimum(shared[first], self.pending[symbols[first]])
        shared = np.minimum(shared.astype(np.int16) + 1, CAP).astype(np.uint8)
        starts = np.flatnonzero(first)
        stops = np.append(starts[1:], len(symbols))
        np.minimum(self.pending, least, out=self.pending)
        last = chosen[stops - 1] + 1
        tail = np.append(np.minimum.accumulate(prefixes[::-1])[::-1], np.uint8(255))
        self.pending[symbols[starts]] = tail[last]
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            self.queues.push(int(symbols[a]), before[a:b], shared[a:b])


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value in each [low, high], by a table of powers of two."""
    spans = high - low + 1
    level = np.frexp(spans.astype(np.float64))[1] - 1
    out = np.empty(len(low), dtype=np.uint8)
    table, width = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(table[low[mine]], table[high[mine] - width + 1])
        if width * 2 > len(values):
            break
        table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, seed_prefixes: np.ndarray, folder: str, limit: int):
    """Suffix and prefix arrays from the sorted seeds (suffixes of type S after one of type L, without the empty one)."""
    n, n_symbols = len(text), int(text.max()) + 1
    runs = _runs(text)
    large = ~small[:-1]
    seed_symbols = text[seeds]
    edges = np.searchsorted(seed_symbols, np.arange(n_symbols + 1))

    up = Queues(folder, limit)
    rising = _Pass(text, large, up, n_symbols)
    rising.take(np.array([n]), np.zeros(1, np.uint8))  # the empty suffix comes first
    used = np.unique(text).tolist()
    for symbol in used:
        at, last, fresh = 0, -1, True
        while at < len(up.blocks.get(symbol, ())):
            positions, prefixes, at = up.batch(symbol, at)
            if fresh:
                prefixes = prefixes.copy()
                prefixes[0] = 0
                fresh = False
            rising.take(positions, prefixes)
            last = int(positions[-1])
        a, b = edges[symbol], edges[symbol + 1]
        if b > a:
            prefixes = seed_prefixes[a:b].copy()
            prefixes[0] = 0 if last < 0 else min(runs[last], runs[seeds[a]])
            rising.take(seeds[a:b], prefixes)

    down = Queues(folder, limit)
    falling = _Pass(text, small[:-1], down, n_symbols)
    parts = []
    for symbol in reversed(used):
        mine, mine_prefixes, at, last, fresh = [], [], 0, -1, True
        while at < len(down.blocks.get(symbol, ())):
            positions, prefixes, at = down.batch(symbol, at)
            if fresh:
                prefixes = prefixes.copy()
                prefixes[0] = 0
                fresh = False
            falling.take(positions, prefixes)
            mine.append(positions)
            mine_prefixes.append(prefixes)
            last = int(positions[-1])
        lower = [up.read(b) for b in up.blocks.pop(symbol, ())]
        if lower:
            positions = np.concatenate([x[0] for x in lower])
            prefixes = np.concatenate([x[1] for x in lower])
            prefixes[0] = 0
            border = 0 if last < 0 else int(min(runs[last], runs[positions[-1]]))
            back = np.append(np.uint8(border), prefixes[:0:-1])
            falling.take(positions[::-1], back)
        else:
            positions, prefixes, border = np.zeros(0, np.int64), np.zeros(0, np.uint8), 0
        upper = np.concatenate(mine)[::-1] if mine else np.zeros(0, np.int64)
        above = np.concatenate(mine_prefixes) if mine else np.zeros(0, np.uint8)
        shifted = np.append(np.uint8(border), above[:0:-1]) if mine else above
        down.blocks.pop(symbol, None)
        parts.append((np.concatenate([positions, upper]), np.concatenate([prefixes, shifted])))
    up.close()
    down.close()
    parts.reverse()
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _sorted_in_memory(text: np.ndarray) -> np.ndarray:
    """Suffix order by doubling prefixes: for reduced strings that fit in memory."""
    n = len(text)
    rank = text.astype(np.int64) + 1
    bits, width = int(rank.max()).bit_length(), 1
    while bits * 2 * width <= 62 and width < n:  # several symbols in one number to begin with
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = rank[width:]
        rank = rank << bits * width | after
        width *= 2
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = rank[width:] if width < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key)
        held = key[order]
        new = np.append(0, np.cumsum(held[1:] != held[:-1])) + 1
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n:
            return order
        width *= 2


def _names(text: np.ndarray, small: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Order-preserving names of the substrings from each mark to the next, symbols compared with their types."""
    symbols = text.astype(np.int64) * 2 + small[:-1] + 1
    bits = int(symbols.max()).bit_length() if len(symbols) else 1
    per_word = max(1, 62 // bits)
    lengths = np.append(np.diff(marks), len(text) - marks[-1]) + 1  # with the next mark, or the end
    padded = np.append(symbols, np.zeros(per_word + 1, dtype=np.int64))
    rank = np.zeros(len(marks), dtype=np.int64)
    done = 0
    active = np.arange(len(marks))
    while len(active):
        word = np.zeros(len(active), dtype=np.int64)
        for k in range(per_word):
            inside = lengths[active] > done + k
            at = np.minimum(marks[active] + done + k, len(padded) - 1)
            word = (word << bits) | np.where(inside, padded[at], 0)
        local = np.zeros(len(marks), dtype=np.int64)
        local[active] = np.unique(word, return_inverse=True)[1] + 1
        rank, sizes = np.unique(rank * (len(marks) + 2) + local, return_inverse=True, return_counts=True)[1:]
        done += per_word
        active = active[(lengths[active] > done) & (sizes[rank[active]] > 1)]
    return rank


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to CAP, eight bytes at a time."""
    padded = np.concatenate([text, np.zeros(CAP + 16, dtype=np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 8,), (1,))
    out = np.zeros(len(a), dtype=np.int64)
    active = np.arange(len(a))
    for at in range(0, CAP, 8):
        if not len(active):
            break
        differ = words[np.minimum(a[active] + at, len(words) - 1)] ^ words[np.minimum(b[active] + at, len(words) - 1)]
        same = differ == 0
        out[active[same]] = at + 8
        rest = differ[~same]
        low = rest & (~rest + np.uint64(1))
        out[active[~same]] = at + (np.frexp(low.astype(np.float64))[1] - 1) // 8
        active = active[same]
    out = np.minimum(out, len(text) - np.maximum(a, b))
    return np.minimum(out, CAP).astype(np.uint8)


def _order(text: np.ndarray, folder: str, in_memory: int, limit: int, prefixes: bool):
    small = _types(text)
    marks = np.flatnonzero(small[1:-1] & ~small[:-2]) + 1
    if len(marks):
        names = _names(text, small, marks)
        if names.max() + 1 == len(marks):
            order = np.argsort(names, kind="stable")
        elif len(marks) <= in_memory:
            order = _sorted_in_memory(names)
        else:
            order = _order(names, folder, in_memory, limit, False)[0]
        seeds = marks[order]
    else:
        seeds = marks
    shared = np.zeros(len(seeds), dtype=np.uint8)
    if prefixes and len(seeds):
        shared[1:] = _common(text, seeds[:-1], seeds[1:])
    return _induce(text, small, seeds, shared, folder, limit)


def suffix_order(text: np.ndarray, folder: str | None = None, in_memory: int = IN_MEMORY, limit: int = QUEUE_BYTES):
    """Suffix array and common prefixes (up to CAP, with the suffix before) of a byte array."""
    if len(text) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    with tempfile.TemporaryDirectory(dir=folder) as own:
        return _order(text, own, in_memory, limit, True)
