"""Binary sources as files and as bytes: frames, records, events, datasets, linked data, typed arrays, models."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import graph as G
from tessera.operators import inference as I
from tessera.operators import registry as R
from tessera.sources import dataset as D
from tessera.sources import frames as S
from tessera.sources import linked as L
from tessera.sources import wire as W

SHARD = W.Shard([W.GraphNode("a", ["P", "Q"], {"x": 1})], [W.GraphEdge("a", "b", "K", {"w": 2.5})], {"m": [1, None]})
VALUES = [SHARD, W.Media("image", (1, 20, 30), b"abc"), W.Media("audio", (1, 44100, 2), b"xyz"), W.RichText("hi", [1, -2], [(0, 1, 2)]), W.Delta(7, [(1, 0, "v"), (2, 1, None), (3, 2, [1])]),
          W.Adjacency(4, [0, 1, 2], bytes(8)), W.TensorRef(1, b"k"), W.Bitmask([True, False, True]), W.Shard([W.GraphNode("a", [], {})], [], {}, "nodes"), W.Shard([], [W.GraphEdge("a", "b", "", {})], {}, "edges")]


@pytest.mark.parametrize("generation", [1, 2])
def test_every_tag_round_trips(generation):
    for v in VALUES:
        assert W.decode(W.encode({"v": v, "w": [v]}, generation)) == {"v": v, "w": [v]}
        W.jsonable(v)
    assert b"".join(W.encode_parts({"v": VALUES})) == W.encode({"v": VALUES})


def test_fingerprint_is_the_formats():
    # fixed value: the low half of the fingerprint of this shape
    assert f"{S.fingerprint({'name': 'x', 'age': 1, 'score': 1.5}) & 0xFFFFFFFF:08x}" == "e065f360"
    assert S.fingerprint({"a": 1, "b": "x"}) == S.fingerprint({"b": "y", "a": 2}) != S.fingerprint({"a": 1.5, "b": "x"})


def test_damaged_bytes_are_errors_of_one_kind():
    rng = random.Random(3)
    made = [W.encode({"k": VALUES, "t": "xyz" * 300}, compression=c) for c in (None, "gzip", "zstd")]
    made += [S.frame({"k": 1, "t": "x" * 600}, {"m": 1}, c) for c in (None, "gzip", "zstd")]
    for _ in range(4000):
        raw = bytearray(rng.choice(made))
        for _ in range(rng.randint(1, 3)):
            raw[rng.randrange(len(raw))] ^= 1 << rng.randrange(8)
        raw = bytes(raw[: rng.randint(1, len(raw))]) if rng.random() < 0.3 else bytes(raw)
        for read in (W.decode, lambda b: list(S.split_frames(b))):
            try:
                read(raw)
            except (W.WireError, struct.error, RecursionError):
                pass
    with pytest.raises(W.WireError, match="CRC"):
        list(S.split_frames(made[3][:-6] + b"\0" + made[3][-5:]))


def test_files_of_streams(spark, tmp_path):
    frames = S.frame({"k": 1}, {"m": 2}) + S.frame({"k": 2, "t": "x" * 500}) + W.encode({"k": 3})
    files = {"frames": frames, "records": W.encode([1, 2], 1) + W.encode({"a": "b"}, 1), "length": W.write_length_prefixed([W.encode(1), W.encode("x")])}
    files["text"] = b"@frame{v=1 sid=7 seq=1 kind=doc len=3 crc=" + b"%08x" % __import__("zlib").crc32(b"a\nb") + b"}\na\nb\n@frame{v=1,sid=7,seq=2,kind=4,len=0,final=1}\n\n"
    files["events"] = S.event_stream([{"kind": "node", "id": "n", "labels": ["A", "B"], "props": {"x": 1}, "ts": 5}, {"kind": "edge", "op": "delete", "label": "K", "src": "n", "dst": "m"}, {"kind": "triple", "subject": "s", "predicate": "p", "object": "o", "graph": "g"}])
    for name, content in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "whole").write_bytes(content)
        (tmp_path / name / "cut").write_bytes(content[:-2])

    def rows(df):
        return {k: [r for r in df.orderBy("index").collect() if r.path.endswith(k)] for k in ("whole", "cut")}

    got = rows(S.read_typed_frames(spark, f"{tmp_path}/frames", {S.fingerprint({"k": 1}) & 0xFFFFFFFF: lambda v: {"k": v["k"] * 10}}))
    assert [r.payload for r in got["whole"]][::2] == ['{"k":10}', '{"k":30}'] and got["whole"][0].meta == '{"m":2}' and got["cut"][-1].error
    got = rows(S.read_records(spark, f"{tmp_path}/records"))
    assert [r.payload for r in got["whole"]] == ["[1,2]", '{"a":"b"}'] and got["cut"][-1].error == "ERR_TRUNCATED"
    got = rows(W.read_length_prefixed(spark, f"{tmp_path}/length"))
    assert [r.json for r in got["whole"]] == ["1", '"x"']
    got = rows(S.read_text_frames(spark, f"{tmp_path}/text"))
    assert [(r.sid, r.seq, r.kind, r.payload, r.final) for r in got["whole"]] == [(7, 1, "doc", "a\nb", False), (7, 2, "ack", "", True)]
    got = rows(S.read_events(spark, f"{tmp_path}/events"))
    assert [(r.kind, r.op, r.labels, r.label, r.predicate) for r in got["whole"]] == [("node", "upsert", ["A", "B"], None, None), ("edge", "delete", None, "K", None), ("triple", "upsert", None, None, "p")]
    kept = W.read_documents(spark, f"{tmp_path}/records", max_bytes=3, too_large="drop")
    assert kept.count() == 0
    with pytest.raises(Exception, match="ERR_TOO_LARGE"):
        W.read_documents(spark, f"{tmp_path}/records", max_bytes=3).collect()


def test_records_wait_for_the_rest():
    data = W.encode([1, 2, 3, 4, "x"], 1) + W.encode({"a": 1}, 1)
    for k in range(1, len(data)):
        buffer = S.RecordBuffer()
        assert buffer.feed(data[:k]) + buffer.feed(data[k:]) == [[1, 2, 3, 4, "x"], {"a": 1}]


def test_datasets(spark, tmp_path):
    d = D.Dataset("d").add_edge_type("u", "likes", "i").add_feature("u", "x", "float32", [2]).add_label("u", "y", "int64", [])
    nodes = [{"id": 5, "labels": ["U"], "props": {"a": 1}, "ts": 9}, {"id": 6, "labels": []}]
    edges = [{"src": 5, "dst": 6, "weight": 0.5}, {"src": 6, "dst": 5, "ts": 3}]
    x = np.array([[1, 2], [3, 4.5]])
    d.sections = [D.node_section("u", nodes), D.edge_section("e", edges), D.feature_section("x", "float32", [2], x), D.feature_section("r", "float64", [2], x, [5, 6]),
                  D.split_section("s", {"train": [0, 2], "test": [1]}), D.split_section("m", {"train": [0, 2], "val": [9]}, 10), D.rows_section("csr", [0, 1, 2], [1, 0])]
    assert nodes[0]["props"] == {"a": 1}  # the caller's record is left as it is
    for minor in (False, True):
        for packed in (False, True):
            back = D.decode_dataset(D.encode_dataset(d, minor, packed))
            assert (back.name, back.edge_types, back.features, [s.name for s in back.sections]) == (d.name, d.edge_types, d.features, [s.name for s in d.sections])
            arrays = D.to_numpy(back)
            assert arrays["features"]["x"].tolist() == x.tolist() and arrays["edge_index"]["e"].tolist() == [[5, 6], [6, 5]] and arrays["splits"]["m"]["val"].tolist() == [9]
            assert arrays["rows"]["csr"][0].tolist() == [0, 1, 2] and arrays["ids"]["u"].tolist() == [5, 6]
    (tmp_path / "d").write_bytes(D.encode_dataset(d, packed=True))
    sections = D.read_datasets(spark, f"{tmp_path}/d")
    assert sections.count() == 8
    assert {(r.id, r.ts) for r in D.section_rows(sections, "node_table").collect()} == {(5, 9), (6, 0)}
    assert {(r.src, r.weight, r.ts) for r in D.section_rows(sections, "edge_table").collect()} == {(5, 0.5, 0), (6, 0.0, 3)}
    assert {(r.part, r.id) for r in D.section_rows(sections.where("name = 's'"), "split").collect()} == {("train", 0), ("train", 2), ("test", 1)}
    with pytest.raises(W.WireError):
        D.read_feature(d.section("x").body, "int64")


def test_linked_documents():
    doc = L.Linked().add_prefix("s", "http://schema.org/").add_term("name", "s:name").add_list_term("tags", "s:tags").add_id_term("knows", "s:knows").add_set_term("set", "s:set")
    doc.root = {"id": doc.iri("s:me"), "knows": [L.Blank("b1"), doc.iri("s:you")], "born": doc.literal("2000", "s:Date"), "n": 5}
    back = L.decode_linked(L.encode_linked(doc))
    assert (back.root, back.terms, back.iris, back.datatypes) == (doc.root, doc.terms, doc.iris, doc.datatypes) and [t[2] for t in back.terms] == [0, L.LIST, L.ID, L.SET]
    assert L.of_jsonld(L.jsonable(doc.root)) == doc.root


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**31), 2**31 - 1), max_size=30))
def test_group_varints(values):
    assert A.of_group_varint(A.group_varint(values)) == values


def test_tensors():
    assert A.view(A.tensor_of([1, 2.5]), 1).tolist() == [1, 2.5] and A.view(A.tensor_of([1.0]), 12) is None
    assert A.auto_tensor([1, 2]).dtype == 7 and A.auto_tensor([1, 2.5]).dtype == 1 and A.auto_tensor([1, 2.5], True).dtype == 12 and A.auto_tensor([1, "x"]) is None
    A.register_decoder("x", len)
    assert A.is_registered("x")
    A.unregister_decoder("x")
    assert not A.is_registered("x")


def test_models_by_part_are_models_of_the_whole(spark):
    rng = np.random.default_rng(2)
    nodes = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(20)], "id long, values array<double>")
    edges = spark.createDataFrame([tuple(map(int, e)) for e in {tuple(x) for x in rng.integers(0, 20, (50, 2)).tolist()}], "src long, dst long")
    weights = [rng.normal(size=(3, 4)), rng.normal(size=(4, 2))]
    # a convolution needs the degrees of what it hears from: one hop more than it has layers
    for model, hops in ((I.convolution(weights), 3), (I.attention(weights, [rng.normal(size=8), rng.normal(size=4)]), 3)):
        whole = {r.id: r.logits for r in I.node_logits(nodes, edges, model).collect()}
        parts = {r.id: r.logits for r in I.node_logits_by_part(nodes, edges, model, 3, hops).collect()}
        assert whole.keys() == parts.keys() and all(np.allclose(whole[i], parts[i]) for i in whole)
    found = I.classified(I.node_logits(nodes, edges, I.convolution(weights))).collect()
    assert all(sum(r.probabilities) == pytest.approx(1) and r.confidence == max(r.probabilities) == r.probabilities[r["class"]] for r in found)


def test_both_plans_of_acyclic_operators(spark):
    rng = np.random.default_rng(6)
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in rng.integers(0, 25, (45, 2)).tolist() if a != b], "src long, dst long")
    nodes = spark.createDataFrame([(i, float(1 + i % 3)) for i in range(25)], "id long, weight double")
    for run in (lambda k: G.topological_levels(nodes, edges, one_task=k), lambda k: G.critical_path(nodes, edges, one_task=k), lambda k: G.dag_shortest_path(nodes, edges, 0, one_task=k)):
        assert sorted(map(tuple, run(True).collect())) == sorted(map(tuple, run(False).select(*run(True).columns).collect()))
    with pytest.raises(G.NotAcyclic):
        G.topological_levels(spark.range(3), spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long"), one_task=False)


def test_registries(spark):
    assert R.context_id_of(["a", "b"]) == spark.range(1).select(R.context_id(F.array(F.lit("a"), F.lit("b"))).alias("x")).first().x
    uses = spark.createDataFrame([("a", 1, "store"), ("b", 2, "store"), ("a", 3, "touch"), ("c", 4, "store"), ("b", 5, "evict"), ("d", 6, "touch")], "k string, t long, op string")
    assert [tuple(r) for r in R.resident(uses, "k", "t", "op", 2).collect()] == [("c", 4), ("a", 3)]
    definitions = spark.createDataFrame([("x", ["a"], 1), ("y", ["b"], 2), ("x", ["a"], 3), ("z", ["c"], 4)], "id string, keys array<string>, t long")
    assert [r.id for r in R.latest_contexts(definitions, "t", 2).collect()] == ["z", "x"]
