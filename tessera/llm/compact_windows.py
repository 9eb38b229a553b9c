"""Substring deduplication by compact windows.

A document is a sequence of 5-word shingles.  Under each of ``FUNCTIONS`` hash functions the nodes of
the sequence's Cartesian tree that span at least ``MIN_SHINGLES`` shingles are its compact windows:
(l, c, r) stands for all passages within [l, r] that contain c, whose min-hash is that of c.  Every
passage of that length lies in exactly one window of each function, and reaches ``SIDE`` shingles from c
to one side at least.  So windows are grouped by two hashes, the min-hash at c and that of the ``SIDE``
shingles beside c: a phrase that many documents share makes no group unless its surroundings agree too.

Groups are read in order, whatever their size.  First each member is paired with the group's least text;
pairs that meet ``ENOUGH`` times, the intervals of their windows joined over all functions, are verified on
whole texts, and what is linked so far falls into classes.  Most groups then lie within one class and are
done.  The members of the others are intervals, the shingles within ``REACH`` of their c.  Equal ones of a class count
once, and those that share too little with the other classes of their group for any passage drop out, whatever the
group's size.  All that stay are compared block by block, across classes alone: members of the group's largest class
with the others, and the others with each other.  Pairs that hold a passage at the threshold are linked, and a spanning
forest of them is verified on whole texts like the first ones.
Passages whose shingle sets reach the Jaccard threshold are the result.
"""

from __future__ import annotations

import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ship, text_of, text_slices, tidy, write_table
from tessera.llm.exact_dedup import filter_bits, slot_filter, with_membership
from tessera.llm.lsh_forest import _shared, components
from tessera.llm.shingles import N_WORDS, _powers, mix, shingles_of, words_of

#: A passage at the threshold meets its partner under one of them, to one side, with probability 1 - (1 - 0.8 * 0.8) ** FUNCTIONS at least.
FUNCTIONS = 4
#: A passage has at least 50 words, so many shingles.
MIN_SHINGLES = 46
#: Meetings that make a pair with the least text of a group worth verifying at once.
ENOUGH = 3
#: Shingles beside c that a group agrees on, and around c that are compared.
SIDE, REACH = 22, 45
THRESHOLD = 0.8
#: Shingles beyond the compared ones, on either side, over which a pair's passages may go on when whole texts are verified.
MARGIN = 256
#: Shared shingles beside those that agree as two members lie, above which a shift between them is looked for.
SHIFTED = 4
#: Members that one block of a group should hold; all blocks that hold members of different classes are paired.
BLOCK_MEMBERS = 256
#: Members of a group above which they go to disk, and slots in which the classes of its shingles are then noted.
LARGE_GROUP, SLOTS = 40_000, 1 << 21
#: Runs of agreeing shingles that are joined into one passage, beside those that the maximal segments join: of twice
#: ``MIN_SHINGLES`` places at the threshold a ninth differ, which makes a dozen runs at most.
RUNS = 24


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of each ``width`` consecutive values."""
    n = len(values)
    fill = np.iinfo(values.dtype).max if pick is np.minimum else np.iinfo(values.dtype).min
    padded = np.full(-(-n // width) * width, fill, dtype=values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = pick.accumulate(rows, axis=1).ravel()
    back = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def compact_windows(values: np.ndarray, counts: np.ndarray, function: int, width: int = MIN_SHINGLES):
    """(document, l, c, r, min-hash) of all windows of at least ``width`` places, places counted in the document."""
    n = len(values)
    if n < width:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    hashed = mix(values + np.uint64((function + 1) * 0xA24BAED4963EE407 % (1 << 64)))
    least = _sliding(hashed, width, np.minimum)
    # a place is a node of such a span if it holds the minimum of some window: the greatest minimum of those it is in
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(around, width, np.maximum) == hashed)
    stops = np.cumsum(counts)
    starts = stops - counts
    places = np.concatenate([starts - 1, chosen])  # a stop less than any value before each document
    order = np.lexsort((np.concatenate([np.zeros(len(starts), np.int8), np.ones(len(chosen), np.int8)]), np.concatenate([starts, chosen])))
    ranks = np.concatenate([np.zeros(len(starts), np.uint64), hashed[chosen] | np.uint64(1)])[order].tolist()
    at = places[order].tolist()
    left, right = [0] * len(at), [n - 1] * len(at)
    stack: list[int] = []
    for i, rank in enumerate(ranks):
        while stack and ranks[stack[-1]] > rank:
            right[stack.pop()] = at[i] - 1 if rank else at[i]
        left[i] = at[stack[-1]] + 1 if stack else 0
        stack.append(i)
    real = order >= len(starts)
    c = places[order][real]
    low, high = np.array(left)[real], np.array(right)[real]
    wide = high - low + 1 >= width
    c, low, high = c[wide], low[wide], high[wide]
    document = np.searchsorted(stops, c, side="right")
    base = starts[document]
    return document, low - base, c - base, high - base, hashed[c]


def _segments(member: np.ndarray, penalty: int) -> list[tuple[int, int]]:
    """Disjoint maximal scoring stretches [a, b) where a member scores 1 and another place -penalty."""
    edges = np.flatnonzero(np.diff(member.astype(np.int8))) + 1
    edges = [0, *edges.tolist(), len(member)]
    found: list[list] = []  # [start, stop, sum before, sum through]
    total = 0
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if not member[a]:
            total -= penalty * (b - a)
            continue
        piece = [a, b, total, total + b - a]
        total += b - a
        while found:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= piece[2]:
                k -= 1
            if k < 0 or found[k][3] >= piece[3]:
                break
            piece = [found[k][0], piece[1], found[k][2], piece[3]]
            del found[k:]
        found.append(piece)
    return [(p[0], p[1]) for p in found]


def _spread(values: np.ndarray) -> np.ndarray:
    """Running number of places whose value did not stand within the last 2 * MIN_SHINGLES places, from 0."""
    order = np.argsort(values, kind="stable")
    again = values[order[1:]] == values[order[:-1]]
    near = again & (np.diff(order) <= 2 * MIN_SHINGLES)
    held = np.ones(len(values), dtype=np.int64)
    held[order[1:][near]] = 0
    return np.concatenate([[0], np.cumsum(held)])


def _widened(low: int, high: int, n: int, width: int) -> set[tuple[int, int]]:
    """[low, high) within n places, or where it is shorter than ``width``, grown to it from either end."""
    low, high = max(0, low), min(n, high)
    if high - low >= width:
        return {(low, high)}
    right, left = max(0, min(low, n - width)), max(0, high - width)
    return {(right, right + width), (left, left + width)}


def _best(a: np.ndarray, b: np.ndarray, member: np.ndarray, place: np.ndarray, begin: int, stop: int, width: int):
    """(start, length, start in b, length in b, Jaccard) of [begin, stop) of ``a`` and what agrees best with it in ``b``."""
    inside = np.flatnonzero(member[begin:stop]) + begin
    shift = place[inside] - inside
    values, counts = np.unique(shift, return_counts=True)
    usual = int(values[counts.argmax()])
    near = np.abs(shift - usual) <= max(8, (stop - begin) // 4)
    # where the passage lies in b: what its shingles reach, or the same stretch moved by the usual shift
    reach = int(place[inside][near].min()), int(place[inside][near].max()) + 1
    best = None
    for first, last in sorted(_widened(begin, stop, len(a), width)):
        mine = np.unique(a[first:last])
        places = _widened(first + usual, last + usual, len(b), width) | _widened(*reach, len(b), width)
        for low, high in sorted(places):
            theirs = np.unique(b[low:high])
            shared = len(np.intersect1d(mine, theirs, assume_unique=True))
            jaccard = shared / (len(mine) + len(theirs) - shared)
            if best is None or jaccard > best[4]:
                best = (first, last - first, low, high - low, jaccard)
    return best


def _stretches(a, b, member, place, threshold: float, width: int) -> np.ndarray:
    """Stretches [begin, stop) of ``a`` from the start of one run of agreeing shingles to the end of another that may reach the threshold.

    A passage at the threshold has a part of ``width`` to twice as many shingles at the threshold, which spans fewer than
    ``RUNS`` runs, and it gains by taking in the whole of the runs it cuts.
    """
    where = np.flatnonzero(member)
    new = np.ones(len(where), dtype=bool)
    new[1:] = (np.diff(where) > 1) | (np.abs(np.diff(place[where] - where)) > 8)
    starts, stops = where[new], where[np.append(np.flatnonzero(new)[1:], len(where)) - 1] + 1
    held = np.concatenate([[0], np.cumsum(member)])
    mine, theirs = _spread(a), _spread(b)
    found = []
    for more in range(min(RUNS, len(starts))):
        i, j = starts[: len(starts) - more], stops[more:]
        shared = held[j] - held[i]
        length = np.maximum(mine[j] - mine[i], width)
        low, high = place[i], place[j - 1] + 1
        reach = np.where(high > low, theirs[high] - theirs[np.minimum(low, high)], length)
        other = np.where(reach >= threshold * length, np.minimum(reach, length), length)
        other = np.maximum(np.maximum(other, threshold * shared), width)
        likely = shared >= (threshold - 0.03) * (length + other - np.minimum(shared, np.minimum(length, other)))
        found.append(np.stack([i[likely], j[likely], shared[likely]]))
    return np.concatenate(found, axis=1)


def verified_passages(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, width: int = MIN_SHINGLES):
    """(start, length, start in b, length in b, Jaccard) of disjoint stretches of ``a`` that reach the threshold in ``b``.

    Stretches of agreeing shingles are joined over the gaps that edits leave and grown to ``width``; each is judged by its exact
    Jaccard similarity, the longest first.
    """
    if len(a) < width or len(b) < width:
        return
    order = np.argsort(b, kind="stable")
    sorted_b = b[order]
    at = np.minimum(np.searchsorted(sorted_b, a), len(b) - 1)
    member = sorted_b[at] == a
    if not member.any():
        return
    place = order[at]
    penalty = max(1, round(2 * threshold / (1 - threshold)))  # J of a and b at the threshold: 2J / (1 + J) of the places agree
    whole = [s for s in _segments(member, penalty) if s[1] - s[0] >= width]
    held = np.concatenate([[0], np.cumsum(member)])
    tried = np.array([[x, y, held[y] - held[x]] for x, y in whole], dtype=np.int64).reshape(-1, 3).T
    tried = np.concatenate([tried, _stretches(a, b, member, place, threshold, width)], axis=1)
    tried = tried[:, np.lexsort((tried[0], tried[1] - tried[0], -tried[2]))]
    while tried.shape[1]:
        begin, stop = int(tried[0, 0]), int(tried[1, 0])
        tried = tried[:, 1:]
        best = _best(a, b, member, place, begin, stop, width)
        if best[4] >= threshold - 1e-9:
            yield best
            tried = tried[:, (tried[0] >= best[0] + best[1]) | (tried[1] <= best[0])]


def beside_hashes(values: np.ndarray) -> np.ndarray:
    """Min-hashes of all ``SIDE`` consecutive shingles, the same for all functions."""
    return _sliding(mix(values + np.uint64(0x51ED270B9C1A2E37)), SIDE, np.minimum) if len(values) >= SIDE else np.zeros(0, np.uint64)


def group_keys(values: np.ndarray, counts: np.ndarray, beside: np.ndarray, function: int):
    """(document, c, key) of all windows of a function: one key for each side of c that has ``SIDE`` shingles."""
    document, _, c, _, least = compact_windows(values, counts, function)
    if not len(c):
        return document, c, least
    at = (np.cumsum(counts) - counts)[document] + c
    sides = []
    for side, (fits, first) in enumerate(((c >= SIDE, at - SIDE), (counts[document] - c > SIDE, at + 1))):
        key = mix(least[fits] * np.uint64(0x9E3779B97F4A7C15) + beside[first[fits]] + np.uint64(side))
        sides.append((document[fits], c[fits], (key & ~np.uint64(7)) | np.uint64(function)))
    return tuple(np.concatenate(x) for x in zip(*sides, strict=True))


def _least_distinct(values: np.ndarray, lengths: np.ndarray, width: int = MIN_SHINGLES) -> np.ndarray:
    """Fewest distinct values of any ``width`` consecutive ones of each member: a place counts where its value did not stand in the window before."""
    n, wide = len(lengths), int(lengths.max(initial=0))
    owner = np.repeat(np.arange(n), lengths)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.lexsort((place, values, owner))
    again = (values[order[1:]] == values[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    before = np.full(len(values), -1)
    before[order[1:][again]] = place[order[:-1][again]]
    # the windows, told by their first places, that a place is counted in: from one to another
    within = np.minimum(width, lengths)
    first = np.maximum(before + 1, np.maximum(place - within[owner] + 1, 0))
    last = np.minimum(place, (lengths - within)[owner])
    counted = first <= last
    rows = owner[counted] * (wide + 1)
    steps = np.bincount(rows + first[counted], minlength=n * (wide + 1)) - np.bincount(rows + last[counted] + 1, minlength=n * (wide + 1))
    counts = np.cumsum(steps.reshape(n, wide + 1), axis=1)
    counts[np.arange(wide + 1) > (lengths - within)[:, None]] = width
    return counts.min(axis=1)


def _aligned(reduced: list[np.ndarray], centres: list[int], threshold: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each two members, laid one on the other at their centres: do they hold a passage as they lie, and how many places agree?"""
    n, wide = len(reduced), 2 * REACH + 1
    laid = np.zeros((n, wide), dtype=np.int64)
    for i, (body, at) in enumerate(zip(reduced, centres, strict=True)):
        laid[i, REACH - at : REACH - at + len(body)] = body
    holds, agree = np.zeros((n, n), dtype=bool), np.zeros((n, n), dtype=np.int64)
    part = 2 * threshold / (1 + threshold)  # of the places of a passage without shifts
    for i in range(n):
        same = (laid[i:] == laid[i]) & (laid[i] > 0)
        through = np.zeros((n - i, wide + 1), dtype=np.int16)
        np.cumsum(same, axis=1, out=through[:, 1:])
        agree[i, i:] = through[:, -1]
        for length in (width, 50, 56, 64, 76, wide):
            holds[i, i:] |= (through[:, length:] - through[:, :-length]).max(axis=1) >= part * length - 1e-9
    return holds, agree


def _may_hold(a: np.ndarray, b: np.ndarray, n_codes: int, threshold: float, width: int) -> bool:
    """Is there a stretch of ``width`` places or more of ``a`` with the threshold's part of them in ``b``?  One that repeats shingles always may."""
    seen = np.zeros(n_codes, dtype=bool)
    seen[a] = True
    if np.count_nonzero(seen) < len(a) or len(a) < width:
        return len(a) >= width
    seen[:] = False
    seen[b] = True
    excess = np.concatenate([[0], np.cumsum(seen[a] - threshold)])
    return bool((excess[width:] - np.minimum.accumulate(excess[: len(a) + 1 - width])).max() >= -1e-9)


def linked_members(
    units: list[int], classes: list[int], bodies: list[np.ndarray], centres: list[int], threshold: float = THRESHOLD, width: int = MIN_SHINGLES
):
    """Spanning forest (member, earlier member) over the classes of the members of a block, or of two, that share a passage.

    ``units`` ascend; members of one class are linked already.  What a member shares with other classes is all that
    matters, so members that are equal but for shingles of their own class are compared as one, if none repeats.
    """
    n = len(units)
    lengths = np.array([len(b) for b in bodies])
    stops = np.cumsum(lengths)
    owner = np.repeat(np.arange(n), lengths)
    values, code = np.unique(np.concatenate(bodies), return_inverse=True)
    held = np.unique(owner * len(values) + code)  # the distinct shingles of each member
    distinct = np.bincount(held // len(values), minlength=n)
    classed = np.unique(classes, return_inverse=True)[1]
    of_class = np.unique(classed[held // len(values)] * len(values) + held % len(values))
    common = np.bincount(of_class % len(values), minlength=len(values)) > 1
    shown = np.bincount(held // len(values), common[held % len(values)], minlength=n)
    # a passage has ``least`` distinct shingles at least, and shares the threshold's part of them
    least = np.minimum(width, lengths)
    repeats = np.flatnonzero(distinct < lengths)
    if len(repeats):
        least[repeats] = _least_distinct(np.concatenate([bodies[i] for i in repeats]), lengths[repeats], width)
    reduced = np.where(common[code], code + 1, 0)
    groups: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(shown >= threshold * least - 1e-9).tolist():
        body = reduced if distinct[i] == lengths[i] else -1 - code  # one that repeats stands for itself
        groups.setdefault(body[stops[i] - lengths[i] : stops[i]].tobytes(), []).append(i)
    members = list(groups.values())
    if not members or len({classes[i] for held in members for i in held}) < 2:
        return
    firsts = np.array([m[0] for m in members])
    one = np.array([classed[m[0]] if (classed[m] == classed[m[0]]).all() else -1 for m in members])
    # members of the largest class meet the others alone, and members of two classes share nothing but common shingles
    largest = np.bincount(one[one >= 0]).argmax() if (one >= 0).any() else -2
    others = np.flatnonzero(one != largest)
    held = held[common[held % len(values)]]
    edges = np.searchsorted(held // len(values), [firsts, firsts + 1]).T.tolist()
    shared = np.zeros((len(firsts), len(firsts)), dtype=np.int64)
    if len(others) and len(firsts) > 1:
        shared[others] = _shared([held[a:b] % len(values) for a, b in edges], others, np.arange(len(firsts)))
        shared[:, others] = shared[others].T
    np.fill_diagonal(shared, shown[firsts])  # between two members of one group
    sizes, least = distinct[firsts], least[firsts]
    jaccard = shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1)
    bound = threshold / (1 + threshold) * (least[:, None] + least[None, :]) - 1e-9  # they share 2J / (1 + J) of their mean
    wanted = np.triu((shared >= bound) & ((one[:, None] != one[None, :]) | (one < 0)))
    root = {c: c for c in classes}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    certain = wanted & (jaccard >= threshold - 1e-9)
    rough = wanted & ~certain
    if rough.any():
        some = np.flatnonzero(rough.any(axis=0) | rough.any(axis=1))
        cells = np.ix_(some, some)
        holds, agree = _aligned([reduced[stops[i] - lengths[i] : stops[i]] for i in firsts[some]], [centres[i] for i in firsts[some]], threshold, width)
        plain = (sizes == lengths[firsts])[some]
        plain = plain[:, None] & plain[None, :]
        certain[cells] |= wanted[cells] & holds & plain
        # what agrees as it lies, and holds no passage so, holds one only by a shift, if nothing repeats
        wanted[cells] &= certain[cells] | (shared[cells] - agree > SHIFTED) | ~plain
    codes = [code[stops[i] - lengths[i] : stops[i]] for i in firsts]
    for sure, pairs in ((True, certain), (False, wanted & ~certain)):
        for g, h in zip(*(x.tolist() for x in np.nonzero(pairs)), strict=True):
            mine, theirs = members[g], members[h]
            if g == h and len(mine) < 2 or len({find(classes[i]) for i in (*mine, *theirs)}) < 2:
                continue
            if not sure and not (_may_hold(codes[g], codes[h], len(values), threshold, width) and _may_hold(codes[h], codes[g], len(values), threshold, width)):
                continue
            if not sure and next(verified_passages(bodies[mine[0]], bodies[theirs[-1]], threshold, width), None) is None:
                continue
            # every member of one with the first of the other
            for i, j in [(mine[0], j) for j in theirs] + [(theirs[0], i) for i in mine]:
                a, b = find(classes[i]), find(classes[j])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    yield max(i, j), min(i, j)


def _run_prints(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs [start, stop) of shingles."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix(values.astype(np.uint64)) * up[: len(values)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def _neighbourhoods(given: DataFrame, met: DataFrame) -> DataFrame:
    """(key, unit, class, lo, centre, body, print): each of ``met`` (key, unit, c, class) with the shingles around its c; equal ones of a text and key are one."""
    places = met.groupBy("unit", "class").agg(F.collect_list(F.struct("key", "c")).alias("places"))  # one for each window of a text
    held = first_texts(given, places).select("unit", "places", "text", "class")

    @tidy
    def cut(batches):
        for batch in batches:
            for part, texts in text_slices(batch, 2):
                values, counts = shingles_of(*words_of(texts))
                values = values.astype("<u4")
                starts = np.cumsum(counts) - counts
                lists = part.column(1)
                owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
                key, c = (lists.flatten().field(i) for i in range(2))
                at = c.to_numpy().astype(np.int64)
                lo = np.maximum(at - REACH, 0)
                hi = np.minimum(at + REACH + 1, counts[owner])
                prints = _run_prints(values, starts[owner] + lo, starts[owner] + hi)
                prints = mix(prints + (at - lo).astype(np.uint64)).view(np.int64)  # with the place of c
                order = np.lexsort((lo, prints, key.to_numpy(), owner))
                new = np.ones(len(order), dtype=bool)
                new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (prints, key.to_numpy(), owner)])
                kept = order[new]
                for begin in range(0, len(kept), 20_000):
                    some = kept[begin : begin + 20_000]
                    bodies = [values[a:b].tobytes() for a, b in zip((starts[owner] + lo)[some].tolist(), (starts[owner] + hi)[some].tolist(), strict=True)]
                    mine = pa.array(owner[some])
                    columns = [key.take(pa.array(some)), part.column(0).take(mine), part.column(3).take(mine), pa.array(lo[some].astype(np.int32)), pa.array((at - lo)[some].astype(np.int32)), pa.array(bodies, pa.binary()), pa.array(prints[some])]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "unit", "class", "lo", "centre", "body", "print"])

    return held.mapInArrow(cut, "key long, unit long, class long, lo int, centre int, body binary, print long")


def _paired(members: DataFrame) -> DataFrame:
    """Members in pairs of blocks ``low`` and ``high`` of their group of ``m`` members.

    Where ``alone`` tells the members of the group's largest class, they meet the ``others`` only: blocks of theirs, numbered
    from -1 down, are paired with blocks of the others, and these with each other.
    """
    if "alone" not in members.columns:
        members = members.withColumn("others", F.col("m")).withColumn("alone", F.lit(False))
    small = F.col("m") <= BLOCK_MEMBERS  # one block, whatever the classes
    number = {"mine": F.when(small, 1).otherwise(F.ceil(F.col("others") / BLOCK_MEMBERS)), "theirs": F.when(small, 0).otherwise(F.ceil((F.col("m") - F.col("others")) / BLOCK_MEMBERS))}
    blocks = members.withColumns({k: n.cast("int") for k, n in number.items()}).withColumn("apart", F.col("alone") & ~small)
    block = F.pmod(F.xxhash64("unit", "lo"), F.when(F.col("apart"), F.col("theirs")).otherwise(F.col("mine")).cast("long")).cast("int")
    blocks = blocks.withColumn("block", block)
    blocks = blocks.withColumn("other", F.explode(F.expr("sequence(if(apart, 0, -theirs), mine - 1)")))
    return blocks.select(
        "key",
        F.when(F.col("apart"), -1 - F.col("block")).otherwise(F.least("block", "other")).alias("low"),
        F.when(F.col("apart"), F.col("other")).otherwise(F.greatest("block", "other")).alias("high"),
        "unit", "class", "lo", "centre", "body",
    )


def first_texts(given: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``, a row for each unit, with ``id`` and ``text`` of the unit's first row in ``given`` (unit, id, text).

    A bounded filter keeps the texts of all other units out of the shuffle.
    """
    bits = filter_bits(wanted.count())
    maybe = with_membership(given, "unit", slot_filter(wanted.select("unit"), "unit", bits, 1), bits, "maybe").where("maybe").drop("maybe")
    found = maybe.groupBy("unit").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text")).alias("first"))  # texts go through one shuffle
    return wanted.join(found.select("unit", "first.id", "first.text"), "unit")


def near_passages(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Passages of at least 50 words that near-duplicate a passage of another document.

    Rows: ``doc_id``, ``start_word``, ``n_words``, ``partner_id``, ``partner_start``, ``partner_words``, ``jaccard``, ``class_id``.
    Rows with equal texts are one text: its first row (least doc_id, null last) stands for it in the pairs, and every
    later copy has one row with the first one as partner.  Pairs of different texts are those that were verified,
    a spanning forest of each class at least, given both ways; ``class_id`` is the least doc_id that a document is linked to by any chain of
    pairs.  Documents without rows have no such passage; null, empty and short texts have none.  Rows that agree
    in doc_id and text count as one document.  Texts of any length are read whole, one slice of a batch at a time.  No
    other column of ``docs`` is read, so none can clash.  doc_id is cast to long.  An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    body = text_of(text)
    given = docs.select(F.xxhash64(F.md5(body.cast("binary"))).alias("unit"), F.col(doc_id).cast("long").alias("id"), body.alias("text"))

    @tidy
    def windows(batches):
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                units = part.column(0).to_numpy()
                values, counts = shingles_of(*words_of(texts))
                beside = beside_hashes(values)
                for f in range(FUNCTIONS):
                    document, c, key = group_keys(values, counts, beside, f)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(units[document]), pa.array(c.astype(np.int32))], names=["key", "unit", "c"]
                    )

    @tidy
    def meet(batches):
        held = None  # rows of the group that the batch before left open: its first and its last
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                rows = [np.concatenate([h, x]) for h, x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            key, unit, c = rows
            old = 0 if held is None else len(held[0])
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            differs = np.zeros(len(key), dtype=bool)
            differs[1:] = ~new[1:] & (unit[1:] != unit[:-1])
            start = np.flatnonzero(new)
            several = np.logical_or.reduceat(differs, start)
            give = np.repeat(several, np.diff(np.append(start, len(new))))
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = new[1:] | (unit[1:] != unit[:-1]) | (c[1:] != c[:-1])  # copies of a text give equal rows
            give &= fresh
            if old and bool(open_given):
                give[:old] = False  # given out with the batch before
            if give.any():
                mine = np.flatnonzero(give)
                lead = start[np.searchsorted(start, mine, side="right") - 1]
                columns = [key[mine], unit[mine], c[mine], unit[lead], c[lead]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "unit", "c", "lead", "lead_c"])
            tail = int(start[-1])
            open_given = bool(several[-1])
            if open_given:  # the last row tells copies from new members
                keep = np.array([len(key) - 1])
                if tail < len(key) - 1:
                    keep = np.array([tail, len(key) - 1])
            else:  # all rows so far are of one text: keep its places
                keep = np.arange(tail, len(key))[fresh[tail:]]
            held = [x[keep] for x in rows]

    spans = given.select("unit", "text").mapInArrow(windows, "key long, unit long, c int")
    dealt = spans.repartition("key").sortWithinPartitions("key", "unit", "c")
    met = write_table(dealt.mapInArrow(meet, "key long, unit long, c int, lead long, lead_c int"), "windows")

    first = _verified(given, _joined(met), threshold)
    roots = components(first.select("a", "b"))
    second = _verified(given, _across(given, met.select("key", "unit", "c"), roots, threshold), threshold)
    return _with_classes(given, first, second, roots)


def _joined(met: DataFrame) -> DataFrame:
    """Pairs (a, b, bounds) of a member with the first of its group: windows joined as intervals over all groups; ``b`` is the lesser text."""
    pairs = met.where("unit <> lead")
    bounds = [f(c).alias(n) for c, s in (("c", "a"), ("lead_c", "b")) for f, n in ((F.min, f"{s}_low"), (F.max, f"{s}_high"))]
    found = pairs.groupBy(F.col("unit").alias("a"), F.col("lead").alias("b")).agg(F.count(F.lit(1)).alias("n"), *bounds).where(F.col("n") >= ENOUGH)
    wide = [F.greatest(F.col(f"{s}_low") - REACH, F.lit(0)).cast("long").alias(f"{s}_low") for s in "ab"] + [(F.col(f"{s}_high") + REACH + 1).cast("long").alias(f"{s}_high") for s in "ab"]
    return found.select("a", "b", *wide)


def _across(given: DataFrame, met: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, bounds) that link members of one group and different classes."""
    classed = met.join(roots.withColumnRenamed("node", "unit"), "unit", "left").select("key", "unit", "c", F.coalesce("root", "unit").alias("class"))
    open_ = classed.groupBy("key").agg(F.min("class").alias("one"), F.max("class").alias("other")).where("one <> other")
    rest = write_table(classed.join(open_.select("key"), "key"), "open")

    @tidy
    def cross(batches):
        yield from _crossing(batches, threshold)

    @tidy
    def link(batches):
        columns = ["a", "b", "a_low", "a_high", "b_low", "b_high"]
        for found in _batched(_linked(batches, threshold)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=columns)

    members = _neighbourhoods(given, rest).repartition("key").sortWithinPartitions("key", "class", "print", "unit", "lo")
    members = members.mapInArrow(cross, "key long, unit long, class long, lo int, centre int, body binary, m long, others long, alone boolean")
    pieces = _paired(members).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "unit", "lo")
    near = pieces.mapInArrow(link, "a long, b long, a_low long, a_high long, b_low long, b_high long")
    bounds = [F.min(c).alias(c) for c in ("a_low", "b_low")] + [F.max(c).alias(c) for c in ("a_high", "b_high")]
    return near.groupBy("a", "b").agg(*bounds)


def _verified(given: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The passages of pairs (a, b, bounds) that reach the threshold, from whole texts, written in the shared folder."""
    pairs = write_table(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("unit")).unionByName(pairs.select(F.col("b").alias("unit"))).distinct()
    needed = first_texts(given, ends)
    ours = needed.select(F.col("unit").alias("a"), F.col("id").alias("a_id"), F.col("text").alias("a_text"))
    theirs = needed.select(F.col("unit").alias("b"), F.col("id").alias("b_id"), F.col("text").alias("b_text"))
    both = pairs.join(ours, "a").join(theirs, "b").select("a", "b", "a_id", "b_id", "a_text", "b_text", "a_low", "a_high", "b_low", "b_high")

    @tidy
    def verify(batches):
        known: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
        more = N_WORDS - 1
        names = ["a", "b", "a_id", "a_start", "a_words", "b_id", "b_start", "b_words", "jaccard"]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                found = []
                for row in batch.slice(at, 64).to_pylist():
                    a = shingles_of(*words_of([row["a_text"].encode()]))[0]
                    if known[0] != row["b_text"]:
                        known = row["b_text"], shingles_of(*words_of([row["b_text"].encode()]))[0]
                    a_low, b_low = (max(0, row[x] - MARGIN) for x in ("a_low", "b_low"))
                    a, b = a[a_low : row["a_high"] + MARGIN], known[1][b_low : row["b_high"] + MARGIN]
                    for begin, length, low, wide, jaccard in verified_passages(a, b, threshold):
                        found.append(
                            (row["a"], row["b"], row["a_id"], a_low + begin, length + more, row["b_id"], b_low + low, wide + more, jaccard)
                        )
                if found:
                    kinds = [pa.int64()] * 8 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    schema = "a long, b long, a_id long, a_start long, a_words long, b_id long, b_start long, b_words long, jaccard double"
    return write_table(both.mapInArrow(verify, schema), "passages")


def _with_classes(given: DataFrame, first: DataFrame, second: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs both ways, the later copies of texts, and the class of each."""
    passages = first.unionByName(second)
    one = passages.select("a", F.col("a_id").alias("doc_id"), F.col("a_start").alias("start_word"), F.col("a_words").alias("n_words"),
                          F.col("b_id").alias("partner_id"), F.col("b_start").alias("partner_start"), F.col("b_words").alias("partner_words"), "jaccard")
    other = passages.select(F.col("b").alias("a"), F.col("b_id").alias("doc_id"), F.col("b_start").alias("start_word"), F.col("b_words").alias("n_words"),
                            F.col("a_id").alias("partner_id"), F.col("a_start").alias("partner_start"), F.col("a_words").alias("partner_words"), "jaccard")
    if not second.isEmpty():  # stars of the first classes stand for the first pairs
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second.select("a", "b")))
    ids = passages.select(F.col("a").alias("unit"), F.col("a_id").alias("id")).unionByName(passages.select(F.col("b").alias("unit"), F.col("b_id").alias("id"))).distinct()
    ids = ids.join(roots.withColumnRenamed("node", "unit"), "unit", "left").select("unit", "id", F.coalesce("root", "unit").alias("root"))
    classes = ids.groupBy("root").agg(F.min("id").alias("class_id"))
    classes = ids.join(classes, "root").select("unit", "class_id")

    # later copies: texts that stand in several rows, told apart by a filter of units first
    prints = given.select("unit")
    n_rows = prints.count()
    bits = filter_bits(n_rows)
    copied = with_membership(given, "unit", slot_filter(prints, "unit", bits, 2), bits, "maybe").where("maybe")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    copied = copied.select("unit", "id", words.alias("n_words")).where(F.col("n_words") >= MIN_SHINGLES + N_WORDS - 1).distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id")).over(Window.partitionBy("unit"))
    later = copied.withColumn("first", first).where(~F.col("id").eqNullSafe(F.col("first.id")))
    whole = later.select(F.col("unit").alias("a"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start_word"), "n_words",
                         F.col("first.id").alias("partner_id"), F.lit(0).cast("long").alias("partner_start"), F.col("n_words").alias("partner_words"), F.lit(1.0).alias("jaccard"))
    rows = one.unionByName(other).unionByName(whole).join(classes.withColumnRenamed("unit", "a"), "a", "left")
    return rows.select(
        "doc_id", "start_word", "n_words", "partner_id", "partner_start", "partner_words", "jaccard", F.coalesce("class_id", "partner_id").alias("class_id")
    )


def _batched(rows, size: int = 10_000):
    """Lists of at most ``size`` rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


def _whole_groups(batches, rows: int = 20_000):
    """Tables of whole groups, ``rows`` rows or a group more, and the number of each row's group."""
    held: list[pa.RecordBatch] = []
    size = 0

    def given(table: pa.Table, last: bool):
        ids = [table.column(k).to_numpy() for k in ("key", "low", "high")]
        new = np.zeros(table.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in ids])
        group = np.cumsum(new)
        cut = table.num_rows if last else int(np.searchsorted(group, group[-1]))  # the last group may go on
        return table.slice(0, cut), group[:cut], table.slice(cut)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table, group, rest = given(pa.Table.from_batches(held), False)
            if len(group):
                yield table.combine_chunks(), group
            held, size = rest.combine_chunks().to_batches(), 0
    if held:
        table, group, _ = given(pa.Table.from_batches(held), True)
        yield table.combine_chunks(), group


def _bodies(table) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all members of a table or batch, one after another, and the number of each."""
    body = table.column("body")
    body = body.combine_chunks() if isinstance(body, pa.ChunkedArray) else body
    if isinstance(body, pa.ChunkedArray):
        body = body.chunk(0)
    offsets = np.frombuffer(body.buffers()[1], dtype=np.int32)[body.offset : body.offset + len(body) + 1] // 4
    return np.frombuffer(body.buffers()[2], dtype="<u4")[offsets[0] : offsets[-1]], np.diff(offsets)


def _enough(shown: np.ndarray, distinct: np.ndarray, values: np.ndarray, lengths: np.ndarray, threshold: float, width: int) -> np.ndarray:
    """Do members show as many distinct shingles as any passage of theirs shares?"""
    enough = shown >= threshold * np.minimum(width, lengths) - 1e-9
    unsure = ~enough & (shown > 0) & (distinct < lengths)  # a repeating member has passages of fewer
    if unsure.any():
        enough[unsure] = shown[unsure] >= threshold * _least_distinct(values[np.repeat(unsure, lengths)], lengths[unsure], width) - 1e-9
    return enough


def _sharing(values: np.ndarray, lengths: np.ndarray, group: np.ndarray, classes: np.ndarray, threshold: float, width: int = MIN_SHINGLES) -> np.ndarray:
    """Which members share as many shingles with the other classes of their group as any passage needs."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    code = group[owner].astype(np.uint64) << np.uint64(32) | values
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = code[1:] != code[:-1]
    first = new.copy()
    first[1:] |= owner[1:] != owner[:-1]
    starts = np.flatnonzero(new)
    held = classes[owner]
    common = np.repeat(np.minimum.reduceat(held, starts) < np.maximum.reduceat(held, starts), np.diff(np.append(starts, len(code))))
    distinct = np.bincount(owner[first], minlength=len(lengths))
    shown = np.bincount(owner[first & common], minlength=len(lengths))
    return _enough(shown, distinct, values, lengths, threshold, width)


def _anew(table: pa.Table) -> np.ndarray:
    """Which rows are no equal of the row before: same key, class and print."""
    new = np.ones(table.num_rows, dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (table.column(k).to_numpy() for k in ("key", "class", "print"))])
    return new


def _numbered(table: pa.Table, m: np.ndarray, most: np.ndarray, alone: np.ndarray) -> pa.Table:
    """Members with the counts of their group."""
    columns = {"m": pa.array(m, pa.int64()), "others": pa.array(m - most, pa.int64()), "alone": pa.array(alone)}
    table = table.drop_columns(["print"])
    for name, column in columns.items():
        table = table.append_column(name, column)
    return table.combine_chunks()


def _crossed(table: pa.Table, threshold: float):
    """Batches of the members of whole groups that may be linked across classes, with their number ``m`` in the group, of which
    ``others`` are not ``alone``, that is of the largest class."""
    table = table.filter(pa.array(_anew(table)))
    while table.num_rows:
        key, held = table.column("key").to_numpy(), table.column("class").to_numpy()
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(start, len(key)))
        several = np.repeat(np.minimum.reduceat(held, start) < np.maximum.reduceat(held, start), sizes)
        if several.all():
            keep = _sharing(*_bodies(table), np.repeat(np.arange(len(start)), sizes), held, threshold)
            if keep.all():
                break
        else:
            keep = several
        table = table.filter(pa.array(keep))
    if table.num_rows:
        new = np.append(True, (key[1:] != key[:-1]) | (held[1:] != held[:-1]))  # classes stand in order
        count = np.diff(np.append(np.flatnonzero(new), len(key)))
        count = np.repeat(count, count)
        most = np.repeat(np.maximum.reduceat(count, start), sizes)
        largest = np.repeat(np.minimum.reduceat(np.where(count == most, held, np.iinfo(np.int64).max), start), sizes)
        yield from _numbered(table, np.repeat(sizes, sizes), most, held == largest).to_batches(max_chunksize=10_000)


class _LargeGroup:
    """The members of one group on disk, with the least and the greatest class of its shingles by slots.

    Shingles that share a slot can only let a member stay that might have gone.
    """

    def __init__(self, key: int, threshold: float, limit: int):
        self.key, self.threshold, self.limit = key, threshold, limit
        self.file, self.writer, self.last = tempfile.TemporaryFile(), None, None
        self.least, self.most = np.full(SLOTS, np.iinfo(np.int64).max), np.full(SLOTS, np.iinfo(np.int64).min)

    def add(self, table: pa.Table) -> None:
        if not table.num_rows:
            return
        new = _anew(table)
        mark = [(table.column("class")[i].as_py(), table.column("print")[i].as_py()) for i in (0, table.num_rows - 1)]
        new[0] = mark[0] != self.last
        self.last = mark[1]
        table = table.filter(pa.array(new)).combine_chunks()
        if not table.num_rows:
            return
        if self.writer is None:
            self.writer = pa.ipc.new_stream(self.file, table.schema)
        self.writer.write_table(table, max_chunksize=10_000)
        values, lengths = _bodies(table)
        held = np.repeat(table.column("class").to_numpy(), lengths)
        np.minimum.at(self.least, values & np.uint32(SLOTS - 1), held)
        np.maximum.at(self.most, values & np.uint32(SLOTS - 1), held)

    def _read(self):
        self.file.seek(0)
        for batch in pa.ipc.open_stream(self.file):
            yield pa.Table.from_batches([batch])

    def crossed(self):
        """Like ``_crossed``."""
        self.writer.close()
        common = self.least < self.most
        kept, held = [], Counter()
        for table in self._read():
            values, lengths = _bodies(table)
            code = np.unique(np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths) << np.uint64(32) | values)
            owner = (code >> np.uint64(32)).astype(np.int64)
            shown = np.bincount(owner, common[(code & np.uint64(SLOTS - 1)).astype(np.int64)], minlength=len(lengths))
            kept.append(_enough(shown, np.bincount(owner, minlength=len(lengths)), values, lengths, self.threshold, MIN_SHINGLES))
            classes, counts = np.unique(table.column("class").to_numpy()[kept[-1]], return_counts=True)
            held.update(dict(zip(classes.tolist(), counts.tolist(), strict=True)))
        m = sum(int(k.sum()) for k in kept)
        if len(held) > 1:
            tables = (t.filter(pa.array(k)) for t, k in zip(self._read(), kept, strict=True) if k.any())
            if m <= self.limit:
                yield from _crossed(pa.concat_tables(tables), self.threshold)
            else:
                largest, most = max(held.items(), key=lambda x: (x[1], -x[0]))
                for table in tables:
                    yield from _numbered(table, np.full(table.num_rows, m), most, table.column("class").to_numpy() == largest).to_batches()
        self.file.close()


def _crossing(batches, threshold: float, rows: int = 10_000, limit: int = LARGE_GROUP):
    """The members (in order of key, class, print) that may be linked across the classes of their group, with ``m``, group by group."""
    ready, size, rest, large = [], 0, None, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if large is not None:
            more = int((table.column("key").to_numpy() == large.key).sum())
            large.add(table.slice(0, more))
            table = table.slice(more)
            if table.num_rows:
                yield from large.crossed()
                large = None
        if not table.num_rows:
            continue
        table = pa.concat_tables([rest, table]) if rest is not None else table
        key = table.column("key").to_numpy()
        tail = int(np.searchsorted(key, key[-1]))
        if tail:
            ready.append(table.slice(0, tail))
            size += tail
        rest = table.slice(tail)
        if size >= rows:
            yield from _crossed(pa.concat_tables(ready).combine_chunks(), threshold)
            ready, size = [], 0
        if rest.num_rows > limit:
            large, rest = _LargeGroup(int(key[-1]), threshold, limit), None
            large.add(table.slice(tail))
    if rest is not None:
        ready.append(rest)
    if ready:
        yield from _crossed(pa.concat_tables(ready).combine_chunks(), threshold)
    if large is not None:
        yield from large.crossed()


def _linked(batches, threshold: float):
    """(a, b, bounds of both) of the spanning forest of each group over its classes; ``b`` is the lesser text."""
    for table, group in _whole_groups(batches):
        values, lengths = _bodies(table)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        unit, held, lo, centre = (table.column(k).to_numpy() for k in ("unit", "class", "lo", "centre"))
        alive = np.flatnonzero(_sharing(values, lengths, group, held, threshold))
        edges = np.flatnonzero(np.diff(group[alive], prepend=-1, append=-1) != 0) if len(alive) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            mine = alive[a:b]
            if (held[mine] == held[mine[0]]).all():
                continue
            bodies = [values[offsets[i] : offsets[i + 1]] for i in mine]
            for j, i in linked_members(unit[mine].tolist(), held[mine].tolist(), bodies, centre[mine].tolist(), threshold):
                lows = int(lo[mine[j]]), int(lo[mine[i]])
                yield int(unit[mine[j]]), int(unit[mine[i]]), lows[0], lows[0] + len(bodies[j]), lows[1], lows[1] + len(bodies[i])
