"""Edited passages against brute force over all stretches."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.compact_windows import MIN_SHINGLES, _crossing, _least_distinct, _paired, linked_members, near_passages, verified_passages
from tessera.llm.shingles import shingles_of, words_of
from tests.llm.helpers import frame, prose


def _edited(words, places):
    return [f"edit{k}" if k in places else w for k, w in enumerate(words)]


def _pair(rng, n, places, before=30):
    """Two texts that share a passage of n words, edited in the second."""
    passage = prose(rng, n).split()
    one = prose(rng, before).split() + passage + prose(rng, 30).split()
    other = prose(rng, 25).split() + _edited(passage, places) + prose(rng, before).split()
    return " ".join(one), " ".join(other)


def _brute(a, b):
    """Has a stretch of 46 shingles or more of ``a`` one in ``b`` at Jaccard 0.8?"""
    for size in range(MIN_SHINGLES, len(a) + 1):
        for i in range(len(a) - size + 1):
            mine = set(a[i : i + size])
            for wide in {size - 2, size - 1, size, size + 1, size + 2} - set(range(MIN_SHINGLES)):
                for k in range(len(b) - wide + 1):
                    theirs = set(b[k : k + wide])
                    shared = len(mine & theirs)
                    if shared >= 0.8 * (len(mine) + len(theirs) - shared) - 1e-9:
                        return True
    return False


def _shingled(text):
    return shingles_of(*words_of([text.encode()]))[0]


EDITS = [(50, {25}), (64, {32}), (70, {30, 31}), (89, {45}), (98, {32, 66}), (98, {33, 34, 66, 67}), (48, set()), (60, {20, 40}), (425, set(range(42, 425, 43)))]


@pytest.mark.parametrize("n, places", EDITS)
def test_edited_passages_are_found(n, places):
    import random

    for seed in range(3):
        a, b = map(_shingled, _pair(random.Random(seed), n, places))
        found = list(verified_passages(a, b))
        for begin, length, low, wide, jaccard in found:
            mine, theirs = set(a[begin : begin + length].tolist()), set(b[low : low + wide].tolist())
            assert min(length, wide) >= MIN_SHINGLES and jaccard == pytest.approx(len(mine & theirs) / len(mine | theirs)) and jaccard >= 0.8 - 1e-9
        stops = sorted((f[0], f[0] + f[1]) for f in found)
        if n < 100:
            small = {int(x): k for k, x in enumerate(np.unique(np.concatenate([a, b])))}
            assert bool(found) == _brute([small[int(x)] for x in a][20:-10], [small[int(x)] for x in b][15:-15])
        else:
            assert found and stops[-1][1] - stops[0][0] > 350


def test_edited_passages_make_rows(spark):
    import random

    texts = [t for k, (n, places) in enumerate([(70, {34}), (89, {45}), (98, {32, 66})]) for t in _pair(random.Random(k), n, places)]
    out = near_passages(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()
    assert {frozenset((r.doc_id, r.partner_id)) for r in out} == {frozenset((0, 1)), frozenset((2, 3)), frozenset((4, 5))}


def test_all_members_of_a_large_group_meet(spark):
    members = [(7, i, i % 900, i % 5, 45, b"", 1500) for i in range(1500)]
    frame_ = spark.createDataFrame(members, "key long, unit long, class long, lo int, centre int, body binary, m long")
    met = np.eye(1500, dtype=bool)
    blocks = {}
    for r in _paired(frame_).select("low", "high", "unit").collect():
        blocks.setdefault((r.low, r.high), []).append(r.unit)
    for units in blocks.values():
        met[np.ix_(units, units)] = True
    assert met.all() and max(map(len, blocks.values())) < 700


def _member_batches(members, size):
    rows = sorted(members, key=lambda m: (m[0], m[2], m[6], m[1]))
    names, kinds = ["key", "unit", "class", "lo", "centre", "body", "print"], [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary(), pa.int64()]
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + size], strict=True), kinds, strict=True)], names=names)


@pytest.mark.parametrize("limit", [10_000, 40, 3])
def test_members_that_no_class_shares_go_in_memory_and_on_disk(limit):
    rng = np.random.default_rng(4)
    members, want = [], {}
    for key in range(6):
        phrase = rng.integers(1, 1 << 32, 60, dtype=np.uint32)
        for unit in range(60):
            body = rng.integers(1, 1 << 32, 91, dtype=np.uint32)
            if unit % 10 == 0 and key % 2 == 0:
                body[20:80] = phrase
            held = unit % 7 if key % 3 else 0  # one class alone has no pairs
            body = body.astype("<u4").tobytes()
            if unit % 10 == 0 and key % 2 == 0 and key % 3:
                want.setdefault(key, set()).add((unit, held))
            members += [(key, 100 * key + unit, held, 5, 45, body, hash(body))] * (1 + unit % 2)
    found = [row for batch in _crossing(_member_batches(members, 17), 0.8, 20, limit) for row in batch.to_pylist()]
    for key in range(6):
        mine = [r for r in found if r["key"] == key]
        assert {(r["unit"] - 100 * key, r["class"]) for r in mine} == want.get(key, set()) and {r["m"] for r in mine} <= {len(mine)}
        assert len(mine) == len(want.get(key, ()))


def test_members_of_the_largest_class_meet_the_others_alone(spark):
    m, others = 5120, 40
    members = [(7, i, i if i < others else others, i % 5, 45, b"", m, others, i >= others) for i in range(m)]
    frame_ = spark.createDataFrame(members, "key long, unit long, class long, lo int, centre int, body binary, m long, others long, alone boolean")
    met = np.zeros((m, m), dtype=bool)
    blocks = {}
    for r in _paired(frame_).select("low", "high", "unit").collect():
        blocks.setdefault((r.low, r.high), []).append(r.unit)
    for units in blocks.values():
        met[np.ix_(units, units)] = True
    assert met[:others].all() and max(map(len, blocks.values())) < 700
    assert sum(map(len, blocks.values())) <= m + others * (m // 256 + 1)


def test_blocks_of_the_largest_class_and_of_many_others_all_meet(spark):
    members = [(7, i, i, i % 5, 45, b"", 1500, 600, i >= 600) for i in range(1500)]
    frame_ = spark.createDataFrame(members, "key long, unit long, class long, lo int, centre int, body binary, m long, others long, alone boolean")
    met = np.zeros((1500, 1500), dtype=bool)
    blocks = {}
    for r in _paired(frame_).select("low", "high", "unit").collect():
        blocks.setdefault((r.low, r.high), []).append(r.unit)
    for units in blocks.values():
        met[np.ix_(units, units)] = True
    assert met[:600].all() and met[:, :600].all()


@pytest.mark.parametrize("limit", [10_000, 40, 3])
def test_members_carry_the_counts_of_their_group(limit):
    rng = np.random.default_rng(5)
    body = rng.integers(1, 1 << 32, 91, dtype=np.uint32)
    members = []
    for unit in range(50):
        mine = body.copy()
        mine[unit % 40] = unit + 1
        members.append((3, unit, 9 if unit >= 12 else unit % 3, 5, 45, mine.astype("<u4").tobytes(), unit))
    found = [row for batch in _crossing(_member_batches(members, 17), 0.8, 20, limit) for row in batch.to_pylist()]
    assert {(r["unit"], r["alone"]) for r in found} == {(u, u >= 12) for u in range(50)}
    assert {(r["m"], r["others"]) for r in found} == {(50, 12)}


def test_least_distinct_values_of_windows():
    rng = np.random.default_rng(6)
    bodies = [rng.integers(0, k, n, dtype=np.uint32) for k, n in ((3, 91), (40, 91), (1000, 60), (5, 46), (5, 20), (30, 47))]
    got = _least_distinct(np.concatenate(bodies), np.array([len(b) for b in bodies]))
    assert got.tolist() == [min(len(set(b[i : i + 46].tolist())) for i in range(max(1, len(b) - 45))) for b in bodies]


def test_shingles_of_one_class_link_no_members_of_two():
    rng = np.random.default_rng(8)
    one = rng.integers(1, 1 << 32, 66, dtype=np.uint32)
    other, third = one.copy(), one.copy()
    other[::4] = rng.integers(1, 1 << 32, 17, dtype=np.uint32)  # equal to the first but for shingles of its class
    third[1:21:4] = rng.integers(1, 1 << 32, 5, dtype=np.uint32)  # near the first, whose class it has, and not the other
    assert next(verified_passages(third, other), None) is None and next(verified_passages(one, other), None) is None
    assert not list(linked_members([0, 1, 2], [4, 7, 4], [one, other, third], [30, 30, 30]))
