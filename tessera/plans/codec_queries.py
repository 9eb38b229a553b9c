"""Queries over the text form: parsing, packed records, tables, pools, patches, headers and blob references."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import canonical
from tessera.functions import textcodec as X
from tessera.operators import text as T
from tessera.plans.catalogue import query
from tessera.session import spread, table

ORDER = X.TypeTable().add("Order", X.Field("id", "int", "k"), X.Field("status", "str", "s"), X.Field("clerk", "str", "c", optional=True), version="1")
NATION = X.TypeTable().add("Nation", X.Field("key", "int", "k"), X.Field("name", "str", "n"), X.Field("note", "str", optional=True))



@query("text_parse", "SELECT event_id, event_type AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'a b' AS second, true AS nothing_is_null FROM events")
def text_parse(spark, sf_dir):
    """JSON to canonical text, and back by the parser."""
    text = F.concat(F.lit('{"name":"'), "event_type", F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit(',"nothing":null,"list":[true,"a b"]}'))
    back = table(spark, sf_dir, "events").select("event_id", X.text_to_json(canonical.canonical_text(text)).alias("j"))
    return back.select(
        "event_id",
        F.get_json_object("j", "$.name").alias("name"),
        F.get_json_object("j", "$.k").cast("long").alias("k"),
        F.get_json_object("j", "$.list[1]").alias("second"),
        F.get_json_object("j", "$.nothing").isNull().alias("nothing_is_null"),
    )


@query("text_parse_typed", "SELECT n_nationkey, 'Nation' AS kind, '^r:' || n_regionkey AS region, 'Name' AS tag, n_name AS name, '2025-12-19T20:00:00Z' AS at FROM nation")
def text_parse_typed(spark, sf_dir):
    """Records, references, tagged values and times."""
    text = F.concat(F.lit("Nation{region=^r:"), F.col("n_regionkey").cast("string"), F.lit(' name=Name("'), "n_name", F.lit('") at=2025-12-19T20:00Z} // end'))
    back = table(spark, sf_dir, "nation").select("n_nationkey", X.text_to_json(text, loose=False).alias("j"))
    names = {"kind": "$['$type']", "region": "$.region", "tag": "$.name['$tag']", "name": "$.name['$value']", "at": "$.at"}
    return back.select("n_nationkey", *[F.get_json_object("j", path).alias(name) for name, path in names.items()])


@query(
    "packed_emit",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'Order@(' || o_orderkey || ' ' || o_orderstatus || ' \"' || o_orderpriority || '\")' ELSE 'Order@{bm=0b0}(' || o_orderkey || ' ' || o_orderstatus || ')' END AS text FROM orders",
)
def packed_emit(spark, sf_dir):
    """Dense where every optional field is there, with a bitmap where one is missing."""
    clerk = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority"))
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), clerk.alias("clerk")))
    given = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))
    return given.select("o_orderkey", X.packed_text(doc, ORDER.types["Order"]).alias("text"))


@query("packed_scan", "SELECT o_orderkey, o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS clerk FROM orders")
def packed_scan(spark, sf_dir):
    back = packed_emit(spark, sf_dir).select("o_orderkey", X.packed_to_json("text", ORDER).alias("j"))
    fields = F.from_json("j", "id long, status string, clerk string")
    return back.select("o_orderkey", fields.alias("f")).select("o_orderkey", "f.*")


@query("table_scan", "SELECT n_regionkey, n_nationkey AS key, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'even' END AS note FROM nation")
def table_scan(spark, sf_dir):
    """Typed tables, one for each region, read back row by row."""
    note = F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("∅")
    line = F.concat_ws(" ", F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), "n_name", F.lit('"')), note)
    lines = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    text = F.concat(F.lit("@tab Nation [k n note]\n"), "body", F.lit("\n@end"))
    rows = lines.select("n_regionkey", F.explode(X.table_rows(text, NATION)).alias("j"))
    return rows.select("n_regionkey", F.from_json("j", "key long, name string, note string").alias("f")).select("n_regionkey", "f.*")


@query("loose_table_scan", "SELECT n_regionkey, n_nationkey, n_name FROM nation")
def loose_table_scan(spark, sf_dir):
    """What the table sink writes, the table scan reads."""
    written = T.tabular_lines(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"])
    quoted = F.regexp_replace("text", r"(?m)^\|(\d+)\|(.*)\|$", '|$1|"$2"|')
    rows = written.select("n_regionkey", F.explode(X.loose_table_rows(quoted)).alias("j"))
    return rows.select("n_regionkey", F.from_json("j", "n_nationkey long, n_name string").alias("f")).select("n_regionkey", "f.*")


@query("pooled_documents", "SELECT c_custkey, c_mktsegment AS segment FROM customer")
def pooled_documents(spark, sf_dir):
    """Documents with a pool block; references resolve to its entries."""
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    slot = F.array_position(F.array(*[F.lit(s) for s in segments]), F.col("c_mktsegment")) - 1
    text = F.concat(F.lit(X.emit_pool("S1", segments) + "\n{id="), F.col("c_custkey").cast("string"), F.lit(" segment=^S1:"), slot.cast("string"), F.lit("}"))
    back = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")).select("c_custkey", X.text_to_json(text).alias("j"))
    return back.select("c_custkey", F.get_json_object("j", "$.segment").alias("segment"))


@query("patch_text_ops", "SELECT o_orderkey, u.op, u.path, u.value FROM (SELECT o_orderkey, unnest([{'op': '=', 'path': 'status', 'value': '\"' || o_orderstatus || '\"'}, {'op': '-', 'path': 'clerk', 'value': NULL}, {'op': '~', 'path': 'n', 'value': '2'}]) AS u FROM orders)")
def patch_text_ops(spark, sf_dir):
    text = F.concat(F.lit("@patch @keys=name @target=o:"), F.col("o_orderkey").cast("string"), F.lit("\n= status "), "o_orderstatus", F.lit("\n- clerk\n~ n +2\n@end"))
    ops = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(X.patch_ops(text)).alias("o"))
    return ops.select("o_orderkey", "o.op", "o.path", "o.value")


@query("structural_patch", "SELECT event_id, '@patch @keys=wire @target=' || chr(10) || '= a.k ' || (CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) || chr(10) || '- a.old' || chr(10) || '= b [1 2]' || chr(10) || '@end' AS patch FROM events")
def structural_patch(spark, sf_dir):
    """Nested objects are compared member by member, lists as a whole."""
    k = F.get_json_object("props", "$.k").cast("long")
    before = F.concat(F.lit('{"a":{"k":'), k.cast("string"), F.lit(',"old":1},"b":[1],"c":null}'))
    after = F.concat(F.lit('{"a":{"k":'), (k + 1).cast("string"), F.lit('},"b":[1,2],"c":null}'))
    return table(spark, sf_dir, "events").select("event_id", X.difference_text(before, after).alias("patch"))


@query("structural_patch_apply", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k, NULL::BIGINT AS old, 2 AS second FROM events")
def structural_patch_apply(spark, sf_dir):
    """apply(before, diff(before, after)) is after."""
    k = F.get_json_object("props", "$.k").cast("long")
    before = F.concat(F.lit('{"a":{"k":'), k.cast("string"), F.lit(',"old":1},"b":[1]}'))
    after = F.concat(F.lit('{"a":{"k":'), (k + 1).cast("string"), F.lit('},"b":[1,2]}'))
    back = spread(table(spark, sf_dir, "events").select("event_id", "props")).select("event_id", X.patched_json(before, X.difference_text(before, after)).alias("j"))
    return back.select("event_id", F.get_json_object("j", "$.a.k").cast("long").alias("k"), F.get_json_object("j", "$.a.old").cast("long").alias("old"), F.get_json_object("j", "$.b[1]").cast("int").alias("second"))


@query("blob_references", "SELECT doc_id, 'sha256:' || sha256(text) AS cid, 'text/plain' AS mime, strlen(text) AS bytes, 'doc ' || doc_id AS name FROM documents")
def blob_references(spark, sf_dir):
    """Blob references written and read back."""
    cid = F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256))
    ref = X.blob_text(cid, F.lit("text/plain"), F.octet_length("text"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", X.blob_fields(ref).alias("b")).select("doc_id", "b.*")


@query("text_modes", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'patch' WHEN 1 THEN 'tabular' WHEN 2 THEN 'packed' ELSE 'struct' END AS mode FROM orders")
def text_modes(spark, sf_dir):
    starts = F.array(F.lit("@patch @keys=wire\n@end"), F.lit("  @tab T [a]\n@end"), F.lit("T@(1 2)"), F.lit("T{a=1}"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.detect_mode(F.element_at(starts, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("mode"))


@query("selected_modes", "SELECT user_id, CASE WHEN count(*) >= 3 AND count(DISTINCT event_type) = 1 THEN 'tabular' WHEN count(*) < 100 THEN 'packed' ELSE 'struct' END AS mode FROM events GROUP BY 1")
def selected_modes(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"))
    return users.select("user_id", X.select_mode(F.col("n"), F.col("kinds") == 1, F.col("n") < 100).alias("mode"))


@query("value_bridge", "SELECT event_id, true AS same_text, true AS same_document FROM events")
def value_bridge(spark, sf_dir):
    """Text to binary and back, and binary to text and back: neither loses anything."""
    from tessera.sources import wire

    k = F.get_json_object("props", "$.k")
    events = spread(table(spark, sf_dir, "events").select("event_id", "props", "event_type"))
    given = F.concat(F.lit('{"k":'), k, F.lit(',"t":"'), "event_type", F.lit('","l":[1.5,null,true]}'))
    return events.select("event_id", wire.bridged(given).alias("b")).select("event_id", "b.same_text", "b.same_document")


@query("crc32_values", """WITH tab AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n)))
SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS crc FROM documents, tab""")
def crc32_values(spark, sf_dir):
    """The checksums themselves."""
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query("schema_identity", "SELECT 'Order:1{1:id@k:int 2:status@s:str 3:clerk@c:str?}' AS text, sha256('Order:1{1:id@k:int 2:status@s:str 3:clerk@c:str?}') AS id, true AS read_back")
def schema_identity(spark, sf_dir):
    """The canonical text of a schema, its identity, and the schema read back from it."""
    text = ORDER.canonical()
    return spark.createDataFrame([(text, ORDER.identity(), X.parse_types("@schema{" + text + "}") == ORDER)], "text string, id string, read_back boolean")
