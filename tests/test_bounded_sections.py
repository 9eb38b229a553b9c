"""Sections and texts that are read and written a bounded number of rows at a time."""

import pyarrow as pa

from tessera.sources import dataset as D
from tessera.sources import frames as S


def test_large_tables_are_several_sections(spark, monkeypatch):
    monkeypatch.setattr(D, "SECTION_ROWS", 10)
    edges = [("a", i, 7, 1.0) for i in range(95)] + [("b", 1, 2, 3.0), (None, 4, 5, 6.0)]
    given = spark.createDataFrame(edges, "k string, src long, dst long, weight double")
    bodies = D.section_bodies(given, "k", "edge_table", "placed", "dst")
    held = bodies.collect()
    assert len({r.part for r in held if r.k == "a"}) > 5 and len([r for r in held if r.k == "b"]) == 1
    assert max(len(D.read_edges(bytes(r.body))) for r in held) < 30
    read = D.section_rows(bodies.selectExpr("k as name", "kind", "body"), "edge_table")
    assert sorted((str(r.name), r.src, r.dst, r.weight) for r in read.collect()) == sorted((str(k), *e) for k, *e in edges)


def test_text_frames_come_a_few_at_a_time(spark):
    one = "".join(f"@frame{{v=1 sid=3 seq={i} kind=row len=1}}\nx\n" for i in range(5000))
    given = spark.createDataFrame([(3, one), (4, "no frame"), (5, None), (6, one[: one.index("\n", 40) + 1])], "u long, t string")
    found = S.text_frame_rows(given, "u", "t")
    assert {(r.u, r.seq) for r in found.select("u", "seq").collect()} == {(3, i) for i in range(5000)} | {(6, 0)}
    sizes = found.mapInArrow(lambda batches: (pa.RecordBatch.from_pylist([{"n": b.num_rows}]) for b in batches), "n long").collect()
    assert max(r.n for r in sizes) <= 10_000
