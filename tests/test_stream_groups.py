"""Streams that share a group keep their own parsers, within a micro-batch and from one to the next."""

import pandas as pd

from tessera.streaming import incremental as N


class State:
    exists, held = False, None

    @property
    def get(self):
        return self.held

    def update(self, held):
        self.exists, self.held = True, held


def test_streams_of_a_group_keep_apart():
    pieces = [(1, 0, "{a=", False), (2, 0, "[1 ", False), (1, 1, "5}", True), (2, 1, '"x', False), (2, 2, ' y"]', True), (3, 0, "]", True)]
    alone = []
    for sid in (1, 2, 3):
        parser = N.Incremental()
        alone += [(sid, seq, *e) for s, seq, text, last in pieces if s == sid for e in parser.feed(text, last)]
    for cut in (len(pieces), 4):
        state, found = State(), []
        for part in (pieces[:cut], pieces[cut:]):
            if part:
                frame = pd.DataFrame(part[::-1], columns=["sid", "seq", "piece", "last"])
                for out in N._update((0,), iter([frame]), state):
                    found += [tuple(None if x != x else x for x in r) for r in out.itertuples(index=False)]
        assert sorted(found, key=str) == sorted(alone, key=str)


def test_groups_are_fewer_than_streams(spark, monkeypatch):
    monkeypatch.setattr(N, "STREAM_GROUPS", 2)
    plan = N.parse_events(spark.readStream.format("rate").load().selectExpr("value as sid", "0L as seq", "'1' as piece", "true as last"))
    assert "xxhash64" in plan._jdf.queryExecution().logical().toString()
