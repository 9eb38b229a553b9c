"""Values, ordered data, evolution, text, wire formats and streams."""

import uuid
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import numeric
from tessera.operators import evolve as E
from tessera.operators import ordered as O
from tessera.operators import text as T
from tessera.operators import values as V
from tessera.sources import wire
from tessera.streaming import frames as SF
from tessera.streaming import validator as SV

JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**70), 2**70) | st.floats(allow_nan=False) | st.text(max_size=20) | st.binary(max_size=20),
    lambda x: st.lists(x, max_size=20) | st.dictionaries(st.text(max_size=5), x, max_size=18),
    max_leaves=25,
)


@settings(max_examples=150, deadline=None)
@given(JSON, st.sampled_from([1, 2]), st.sampled_from([None, "gzip", "zstd"]))
def test_wire_round_trip(value, generation, compression):
    assert wire.decode(wire.encode(value, generation, compression=compression)) == value


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60))
def test_any_bytes_are_a_value_or_an_error(data):
    for held in (data, wire.MAGIC + b"\0" + data):
        try:
            wire.decode(held)
        except wire.WireError:
            pass


def test_wire_goldens_from_the_specification():
    assert wire.encode([1, 2, 3]) == b"SJ\x02\0\0\xc3\x41\x42\x43"
    assert wire.encode({"a": 1}) == b"SJ\x02\0\x01\x01a\xd1\0\x41"
    assert [wire.encode(n)[5:] for n in (0, 127, -1, -16)] == [b"\x40", b"\xbf", b"\xe0", b"\xef"]
    assert wire.encode(128)[5:] == b"\x03\x80\x02" and wire.encode(-17)[5:] == b"\x03\x21"
    assert wire.encode(128, 1) == b"\x03\x80\x02"
    extra = [Decimal("-12.345"), uuid.UUID(int=5), wire.Nanos(10**18 + 7), wire.Tensor(1, (2, 3), b"abc"), wire.Extension(9, b"x")]
    assert wire.decode(wire.encode(extra)) == extra
    assert wire.jsonable(wire.Nanos(1_500_000_000)) == "1970-01-01T00:00:01.5Z"
    for data, code in ((b"\xf5", "ERR_INVALID_TAG"), (b"\x05\x05ab", "ERR_TRUNCATED"), (b"\x05\x01\xff", "ERR_INVALID_UTF8"), (b"\x00\x00", "ERR_TRAILING_DATA"), (b"SJ\x02\0\0\xd1\0\x40", "ERR_INVALID_FIELD_ID")):
        with pytest.raises(wire.WireError, match=code):
            wire.decode(data)
    with pytest.raises(wire.WireError, match="ERR_TOO_DEEP"):
        wire.decode(b"\x06\x01" * 2000 + b"\0")


def test_files_of_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.bin").write_bytes(wire.encode({"x": 1}))
    (tmp_path / "b.bin").write_bytes(wire.write_length_prefixed([wire.encode(i) for i in range(3)]))
    assert [r.json for r in wire.read_documents(spark, str(tmp_path / "a")).collect()] == ['{"x":1}']
    assert [r.json for r in wire.read_length_prefixed(spark, str(tmp_path / "b.bin")).orderBy("index").collect()] == ["0", "1", "2"]


def test_typed_fields_need_the_exact_type(spark):
    rows = spark.createDataFrame([('{"a":1}',), ('{"a":"1"}',), ('{"a":null}',), ("{}",), ("bad",), (None,)], "j string")
    value, valid = V.typed_field(F.col("j"), "$.a", "bigint")
    got = [(r.v, r.ok) for r in rows.select(value.alias("v"), valid.alias("ok")).collect()]
    assert got == [(1, True)] + [(None, False)] * 5


def test_masks_halves_and_shuffles(spark):
    row = spark.createDataFrame([(bytearray(b"\x05\x80"), [1.5, -2.0, 0.0, 1e-7, 1e9])], "m binary, v array<float>").select(
        numeric.mask_members(F.col("m")).alias("i"), numeric.float16_values(numeric.float16_bytes("v")).alias("h"), numeric.byte_unshuffled(numeric.byte_shuffled("m", 2), 2).alias("s")
    ).first()
    assert row.i == [0, 2, 15] and row.h == [1.5, -2.0, 0.0, 0.0, float("inf")] and bytes(row.s) == b"\x05\x80"


def test_patch_of_a_diff_is_the_target(spark):
    a = spark.createDataFrame([(1, "x", "1"), (1, "y", "2"), (2, "x", "3")], "k long, field string, value string")
    b = spark.createDataFrame([(1, "x", "9"), (1, "z", "2"), (3, "x", "3")], "k long, field string, value string")
    changes = E.diff(a, b, "k")
    assert {tuple(r) for r in E.apply_changes(a, changes, "k").collect()} == {tuple(r) for r in b.collect()}
    assert tuple(E.diff_stats(changes).first()) == (2, 2, 1)


def test_patches_fold_in_order(spark):
    base = spark.createDataFrame([(1, "n", "1"), (1, "t", "a")], "k long, path string, value string")
    ops = [(1, "n", 1, "~", "2"), (1, "n", 2, "=", "10"), (1, "n", 3, "~", "0.5"), (1, "t", 1, "+", "b"), (1, "t", 2, "+", "c"), (1, "u", 1, "=", "new"), (1, "u", 2, "-", None)]
    out = E.apply_patch(base, spark.createDataFrame(ops, "k long, path string, seq long, op string, value string"), "k")
    assert {r.path: r.value for r in out.collect()} == {"n": "10.5", "t": "a,b,c"}


def test_versions(spark):
    pairs = spark.createDataFrame([("1.10", "1.9"), ("1.0", "1"), ("x", "0"), ("2", "2.0.1")], "a string, b string")
    assert [r[0] for r in pairs.select(E.compare_versions(F.col("a"), F.col("b"))).collect()] == [1, 0, 0, -1]
    schema = E.VersionedSchema("match", ["1.0", "2.0"], [E.EvolvingField("home", required=True), E.EvolvingField("venue", added_in="2.0", default="?")])
    row = schema.migrate(spark.createDataFrame([("Arsenal", 1)], "home string, extra int"), "1.0", "2.0").first()
    assert row.asDict() == {"home": "Arsenal", "venue": "?"}
    with pytest.raises(ValueError):
        schema.migrate(spark.range(1), "2.0", "1.0")


def test_sequences_and_latest_state(spark):
    frames = spark.createDataFrame([(1, p, s) for p, s in enumerate([1, 2, 2, 5, 4, 6])], "sid long, pos long, seq long")
    want = ["first", "ok", "duplicate", "gap", "duplicate", "ok"]
    assert [r.status for r in O.sequence_status(frames).orderBy("pos").collect()] == want
    last, got = None, []
    for s in [1, 2, 2, 5, 4, 6]:
        got.append(SF.judge(last, False, None, s, None))
        last = s if got[-1] in ("first", "ok", "gap") else last
    assert got == want
    assert SF.judge(3, False, "h1", 4, "h2") == "base_mismatch" and SF.judge(3, True, None, 4, None) == "after_final"
    log = [(1, 1, "upsert", 5, None), (1, 2, "upsert", None, 7), (2, 3, "upsert", 1, 1), (2, 4, "delete", None, None), (2, 5, "upsert", None, 9), (3, 6, "delete", None, None)]
    state = O.latest_state(spark.createDataFrame(log, "k long, seq long, op string, a long, b long"), "k", "seq", "op", ["a", "b"])
    assert {tuple(r) for r in state.collect()} == {(1, 5, 7), (2, None, 9)}


def test_predictors(spark):
    series = [("ramp", i, 3.0 * i) for i in range(20)] + [("flat", i, 1.0) for i in range(5)] + [("short", 0, 1.0)]
    df = spark.createDataFrame(series, "k string, i long, v double")
    assert {r.k: r.correlation for r in O.lag_correlation(df, "k", "i", "v").collect()} == {"ramp": pytest.approx(1), "flat": 0, "short": 0}
    assert {r.k: r.predictor for r in O.choose_predictor(df, "k", "i", "v").collect()}["short"] == "none"


def test_text_tables_and_labels(spark):
    rows = spark.createDataFrame([(1, 1, "a|b", None), (1, 2, "c", 5)], "k long, o long, s string, n long")
    assert T.tabular_lines(rows, "k", "o", ["s", "n"]).first().text == "@tab _ rows=2 cols=2 [s n]\n|a\\|b|_|\n|c|5|\n@end"
    labels = spark.createDataFrame([("http://x/y#works at",), ("9lives",), ("",)], "p string").select(T.relation_of(F.col("p")))
    assert [r[0] for r in labels.collect()] == ["works_at", "_9lives", "UNKNOWN"]


def test_token_validator_stops_early_and_checks_all():
    tools = {"search": {"query": SV.Argument(required=True, min_len=2), "n": SV.Argument("int", maximum=10)}}

    def run(*tokens):
        v = SV.Validator(tools)
        for t in tokens:
            v.push(t)
        return v

    good = run("sea", "rch{qu", 'ery="a b\\"c" ', "n=3}")
    assert good.done and not good.errors and good.fields == {"query": 'a b"c', "n": "3"}
    assert run("rm{", "x=1}").errors == ["unknown_tool:rm"]
    assert run('search{query="a" n=99 z=1}').errors == ["min_len:query", "max:n", "unknown_field:z"]
    assert run("search{n=x}").errors == ["type:n", "required:query"]
    assert not run("search{n=1").done


def test_nothing_outside_llm_imports_it():
    from pathlib import Path

    root = Path(__file__).parent.parent / "tessera"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tessera.llm" not in path.read_text(), path


def test_entry_and_catalogue(spark):
    import __spark_entry__ as entry

    known, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(known) and "degree_anomalies" in known
    assert entry.entry(spark).count() > 0


def test_canonical_text_is_one_for_equal_values():
    from tessera.functions.canonical import canonical, number, of_json, word

    text = '{"b":[1,2.50,"two words",null,true],"a":{"z":-0.0,"y":1e20},"a":{"y":1e-7,"t":"t"}}'
    assert canonical(of_json(text)) == '{a={"t"="t" y=1e-07} b=[1 2.5 "two words" _ t]}'
    assert canonical(of_json(text)) == canonical(of_json(text.replace(",", " , ")))
    rows = [{"id": 1, "s": "a|b"}, {"id": 2}, {"s": None, "id": 3}]
    assert canonical(rows) == '@tab _ rows=3 cols=2 [id s]\n|1|"a\\|b"|\n|2|_|\n|3|_|\n@end'
    assert [number(x) for x in (1e6, 999999.5, -0.000123, 1.5e-7, 1234567.5)] == ["1e+06", "999999.5", "-0.000123", "1.5e-07", "1.2345675e+06"]
    assert [word(x) for x in ("a/b-c.d", "9a", "", "null", "é_1", 'q"\u0007')] == ["a/b-c.d", '"9a"', '""', '"null"', "é_1", '"q\\"\\u0007"']
