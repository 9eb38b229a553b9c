"""The text form both ways, packed records, tables, patches, and parsing piece by piece."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import textcodec as X
from tessera.functions.canonical import canonical
from tessera.streaming.incremental import Incremental, change_feed, parse_events

WORDS = st.text(alphabet="ab_é |\"\\\n{}[]=:,@#^0-./tf", max_size=8)
LEAVES = st.one_of(st.none(), st.booleans(), st.integers(-(2**53) + 1, 2**53 - 1), WORDS.filter(lambda w: w != "_"))
VALUES = st.recursive(LEAVES, lambda v: st.one_of(st.lists(v, max_size=4), st.dictionaries(WORDS, v, max_size=4)), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_canonical_text_reads_back(value):
    text = canonical(value, tables=False)
    assert X.plain(X.parse(text, tolerant=False, loose=True)) == value


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["a", "b"]), st.one_of(st.integers(0, 9), st.text(alphabet="xy |", min_size=1, max_size=5)), min_size=2, max_size=2), min_size=3, max_size=5))
def test_tables_read_back(rows):
    assert X.plain(X.parse_document(canonical({"t": rows}))) == {"t": rows}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab{}[]()=:,"\\@#^∅01-.T \n', max_size=25))
def test_parser_never_breaks(text):
    for loose in (False, True):
        try:
            X.parse(text, loose=loose)
        except X.TextError:
            pass


def test_values_of_every_kind():
    v = X.parse('Match{home=^t:ARS n=-3 x=1.5e3 at=2025-12-19T20:00:00+02:00 ok=t no=∅ r=Win(2) e=Tie() l=[1, 2 "a\\"b"]} // note', tolerant=False)
    assert v.type == "Match" and v.fields["home"] == X.Ref("t", "ARS") and v.fields["x"] == 1500 and v.fields["at"] == X.Moment("2025-12-19T18:00:00Z")
    assert v.fields["r"] == X.Tagged("Win", 2) and v.fields["e"] == X.Tagged("Tie", None) and v.fields["l"] == [1, 2, 'a"b'] and v.fields["no"] is None
    parser = X.Parser("{a=1 b=[2", tolerant=True)
    assert parser.whole() == {"a": 1, "b": [2]} and len(parser.warnings) == 2
    for bad in ("{a=1", "[1", "{a 1}", "1 2", "%", "[" * 200 + "]" * 200):
        with pytest.raises(X.TextError):
            X.parse(bad, tolerant=False)
    assert X.parse('@schema{T{a:int}} {a=1}') == {"a": 1}


TYPES = X.TypeTable().add("R", X.Field("a", "int", "x"), X.Field("b", "str", optional=True), X.Field("c", "str", optional=True, keep_null=True))


def test_packed_records_and_tables():
    kind = TYPES.types["R"]
    assert X.packed({"a": 1, "b": "u v", "c": None}, kind) == 'R@(1 "u v" ∅)'
    assert X.packed({"a": 1, "c": "q"}, kind) == "R@{bm=0b10}(1 q)"
    for fields in ({"a": 1, "b": "u v", "c": None}, {"a": 1, "b": None, "c": "q"}, {"a": -5, "b": "t", "c": "∅"}):
        assert X.parse_packed(X.packed(fields, kind), TYPES).fields == fields
        for inline in (False, True):
            assert [r.fields for r in X.parse_table(X.typed_table([fields, fields], kind, inline=inline), TYPES)] == [fields, fields]
    for bad in ("R@()", "R@(1 2 3 4)", "S@(1)", "R(1)", "R@(1) x"):
        with pytest.raises(X.TextError):
            X.parse_packed(bad, TYPES)
    for bad in ("@tab R [x b c]\n1 2 3", "@tab R [x b c]\n1 2 3 4\n@end", "@tab R [b c]\nu v\n@end", "@tab R [x q]\n1 2\n@end"):
        with pytest.raises(X.TextError):
            X.parse_table(bad, TYPES)
    assert X.parse_table("@tab R [x b c]\n@end", TYPES) == []


def test_pools_headers_and_patches():
    assert X.parse_document('@pool.str id=S1 [one\n"two words"]\n@pool.obj id=O1 [{k=1}]\n{a=^S1:1 b=[^O1:0 ^t:9]}') == {"a": "two words", "b": [{"k": 1}, X.Ref("t", "9")]}
    with pytest.raises(X.TextError):
        X.parse_document("@pool.str id=S1 [one]\n^S1:7")
    with pytest.raises(X.TextError):
        X.parse_pool("@pool.str id=S1 [1 2]")
    head = X.Header("v2", "abc", "packed", "fid", "m:1")
    assert X.parse_header(X.emit_header(head)) == head and X.parse_header("@tab _ [a]") is None and X.parse_header("{a=1}") is None
    with pytest.raises(X.TextError):
        X.parse_header("@doc v2 @mode=odd")
    patch = X.Patch("m:1", base="ff").set('a."x y"', [1]).append("l", "z").insert_at("l", 0, "w").delete("q").delta("n", -2)
    assert X.parse_patch(patch.text(in_order=False)) == patch
    assert X.applied({"l": ["1"], "q": 1, "n": 5}, patch) == {"a": {"x y": [1]}, "l": ["w", "1", "z"], "n": 3}


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("abc"), VALUES, max_size=3), st.dictionaries(st.sampled_from("abc"), VALUES, max_size=3))
def test_structural_difference_applies(before, after):
    patch = X.Patch(ops=X.difference(before, after))
    assert X.applied(before, patch) == after


def _events(pieces):
    parser, out = Incremental(), []
    for k, piece in enumerate(pieces):
        out += [e for e in parser.feed(piece, k == len(pieces) - 1) if e[0] != "need_more"]
        parser = Incremental.of(parser.state())  # as it goes through a state store
    return out


def test_incremental_events_do_not_depend_on_the_cuts():
    text = '{a=1 b:[x "y z" {c=T{d=2}}] e=Win(3) f=[]}'
    whole = _events([text])
    assert [e[1:] for e in whole if e[0] == "value"] == [("a", "1"), ("b.0", '"x"'), ("b.1", '"y z"'), ("b.2.c.d", "2"), ("e", "3")]
    for k in range(1, len(text)):
        assert _events([text[:k], text[k:]]) == whole
    assert _events(list(text)) == whole
    for bad in ("{a=1", "{a=1]", "[1}", "{=1}", "{" * 5):
        assert _events([bad])[-1][0] == "error"


def test_streams_keep_state_over_micro_batches(spark, tmp_path):
    text = '{k=12 list=[1 "a b"] name=click}'
    for n, (a, b) in enumerate([(0, 5), (5, 17), (17, len(text))]):
        rows = [(s, n, text[a:b], n == 2) for s in range(3)]
        spark.createDataFrame(rows, "sid long, seq long, piece string, last boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feed = [("x", n, "upsert" if n != 1 else "delete", json.dumps({"v": n}))]
        spark.createDataFrame(feed, "id string, seq long, op string, props string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")

    def drained(stream, name):
        running = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-state")
        running.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{name}")

    given = spark.readStream.schema("sid long, seq long, piece string, last boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = drained(parse_events(given), "events").where("event <> 'need_more'")
    want = _events([text])
    for s in range(3):
        assert sorted((r.event, r.path, r.value or "") for r in out.where(F.col("sid") == s).collect()) == sorted((e, p, v or "") for e, p, v in want)
    feed = spark.readStream.schema("id string, seq long, op string, props string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    assert [(r.seq, r.changed) for r in drained(change_feed(feed), "changes").orderBy("seq").collect()] == [(0, True), (1, True), (2, True)]
