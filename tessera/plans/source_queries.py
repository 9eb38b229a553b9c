"""Queries over binary sources: frames, event streams, datasets, linked data, hinted columns, typed arrays, dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import registry as R
from tessera.plans.catalogue import query
from tessera.session import table
from tessera.sources import dataset as D
from tessera.sources import frames as S
from tessera.sources import linked as L
from tessera.sources import wire as W


@query("typed_frames", "SELECT o_orderkey, o_orderkey AS id, o_orderpriority AS priority, o_orderkey % 7 AS source, 1 AS kinds FROM orders")
def typed_frames(spark, sf_dir):
    """Values with metadata as typed frames and back; equal shapes have equal type ids."""
    value = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority")))
    meta = F.to_json(F.struct((F.col("o_orderkey") % 7).alias("source")))
    read = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(S.frame_payloads(S.to_frame(value, meta))).alias("f"))
    kinds = read.agg(F.countDistinct("f.type_id").cast("int").alias("kinds"))
    return read.crossJoin(F.broadcast(kinds)).select(
        "o_orderkey",
        F.get_json_object("f.payload", "$.id").cast("long").alias("id"),
        F.get_json_object("f.payload", "$.priority").alias("priority"),
        F.get_json_object("f.meta", "$.source").cast("long").alias("source"),
        "kinds",
    )


@query("compressed_frames", "SELECT doc_id, strlen(text) AS n_bytes, sha256(text) AS sha FROM documents")
def compressed_frames(spark, sf_dir):
    """Long payloads are compressed; what is read is what was written."""
    value = F.to_json(F.struct("text"))
    read = table(spark, sf_dir, "documents").select("doc_id", F.explode(S.frame_payloads(S.to_frame(value))).alias("f"))
    text = F.get_json_object("f.payload", "$.text")
    return read.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"))


@query("damaged_frames", "SELECT o_orderkey, o_orderkey % 3 > 0 AS readable FROM orders")
def damaged_frames(spark, sf_dir):
    """A third of the frames lost a byte: their checksum tells."""
    frame = S.to_frame(F.to_json(F.struct("o_orderkey", "o_orderpriority")), compression=None)
    made = table(spark, sf_dir, "orders").select("o_orderkey", frame.alias("b"))
    cut = F.when(F.col("o_orderkey") % 3 > 0, F.col("b")).otherwise(F.expr("substring(b, 1, length(b) - 1)"))
    return made.select("o_orderkey", S.frame_payloads(cut).isNotNull().alias("readable"))


@query("shape_fingerprints", "SELECT shape, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'one' ELSE 'two' END AS shape FROM events) GROUP BY 1")
def shape_fingerprints(spark, sf_dir):
    """Fingerprints follow names and types, not values."""
    doc = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct("event_id", "event_type"))).otherwise(F.to_json(F.struct("event_id")))
    counts = table(spark, sf_dir, "events").groupBy(S.shape_fingerprint(doc).alias("f")).agg(F.count(F.lit(1)).alias("n"), F.max(doc.contains("event_type")).alias("wide"))
    return counts.select(F.when(F.col("wide"), "one").otherwise("two").alias("shape"), "n")


@query("sniffed_streams", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'frames' WHEN 1 THEN 'document' WHEN 2 THEN 'length_prefixed' ELSE 'events' END AS kind FROM nation")
def sniffed_streams(spark, sf_dir):
    doc = W.to_wire(F.to_json(F.struct("n_name")))
    size = F.unhex(F.concat(F.lpad(F.hex(F.octet_length("d")), 2, "0"), F.lit("000000")))
    made = table(spark, sf_dir, "nation").select("n_nationkey", doc.alias("d"), S.to_frame(F.to_json(F.struct("n_name"))).alias("f"))
    k = F.col("n_nationkey") % 4
    content = F.when(k == 0, F.col("f")).when(k == 1, F.col("d")).when(k == 2, F.concat(size, F.col("d"), F.unhex(F.lit("00000000")))).otherwise(F.unhex(F.lit("534A47530100")))
    return made.select("n_nationkey", S.sniff_stream(content).alias("kind"))


@query("text_frame_streams", "SELECT user_id, event_id AS seq, 'row' AS kind, event_type AS payload, false AS final FROM events UNION ALL SELECT user_id, max(event_id) + 1, 'ack', '', true FROM events GROUP BY 1")
def text_frame_streams(spark, sf_dir):
    """Each user's events as one text of frames, closed by a final frame, and read back."""
    events = table(spark, sf_dir, "events")
    frame = S.text_frame(F.col("user_id"), F.col("event_id"), "row", F.col("event_type"))
    last = events.groupBy("user_id").agg((F.max("event_id") + 1).alias("event_id"))
    closing = last.select("user_id", "event_id", S.text_frame(F.col("user_id"), F.col("event_id"), "ack", F.lit(None).cast("string"), final=F.lit(True)).alias("frame"))
    every = events.select("user_id", "event_id", frame.alias("frame")).unionByName(closing)
    texts = every.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "frame"))), lambda x: x["frame"]), "").alias("text"))
    return S.text_frame_rows(texts, "user_id", "text").select("user_id", "seq", "kind", "payload", "final")


@query("text_frame_headers", "SELECT event_id, '@frame{v=1 sid=' || user_id || ' seq=' || event_id || ' kind=doc len=' || strlen(event_type) || ' base=sha256:' || sha256(event_type) || '}' AS head FROM events")
def text_frame_headers(spark, sf_dir):
    frame = S.text_frame(F.col("user_id"), F.col("event_id"), "doc", F.col("event_type"), base=F.sha2(F.col("event_type").cast("binary"), 256), crc=False)
    return table(spark, sf_dir, "events").select("event_id", F.substring_index(frame, "\n", 1).alias("head"))


@query("ui_events", "SELECT event_id, 'Metric' AS kind, event_type AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value, 'count' AS unit FROM events")
def ui_events(spark, sf_dir):
    """Metrics as the payloads of ui frames, parsed again."""
    from tessera.functions.textcodec import text_to_json

    event = S.ui_event("Metric", name=F.col("event_type"), value=F.get_json_object("props", "$.k").cast("long"), unit=F.lit("count"))
    back = table(spark, sf_dir, "events").select("event_id", text_to_json(event, loose=False).alias("j"))
    return back.select(
        "event_id",
        F.get_json_object("j", "$['$type']").alias("kind"),
        F.get_json_object("j", "$.name").alias("name"),
        F.get_json_object("j", "$.value").cast("long").alias("value"),
        F.get_json_object("j", "$.unit").alias("unit"),
    )


def _nation_events(spark, sf_dir):
    """Nations as nodes and their regions as edges, a change log for each region."""
    n = table(spark, sf_dir, "nation")
    node = n.select("n_regionkey", (F.col("n_nationkey") * 2).alias("seq"), F.lit("node").alias("kind"), F.lit("upsert").alias("op"), F.col("n_nationkey").cast("string").alias("id"), F.array(F.lit("Nation"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("labels"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("props"))
    edge = n.select("n_regionkey", (F.col("n_nationkey") * 2 + 1).alias("seq"), F.lit("edge").alias("kind"), F.lit("upsert").alias("op"), F.lit("IN").alias("label"), F.col("n_nationkey").cast("string").alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    return node.unionByName(edge, allowMissingColumns=True)


@query("event_streams", "SELECT n_regionkey, 'node' AS kind, CAST(n_nationkey AS VARCHAR) AS id, 'Nation,R' || n_regionkey AS label, n_name AS name, NULL AS dst FROM nation UNION ALL SELECT n_regionkey, 'edge', CAST(n_nationkey AS VARCHAR), 'IN', NULL, 'r' || n_regionkey FROM nation")
def event_streams(spark, sf_dir):
    """Change logs written as event streams, one for each region, and read back."""
    files = S.event_files(_nation_events(spark, sf_dir), "n_regionkey", "seq")
    e = files.select("n_regionkey", F.explode(S.events_of("content")).alias("e")).select("n_regionkey", "e.*")
    return e.select("n_regionkey", "kind", F.coalesce("id", "src").alias("id"), F.coalesce("label", F.array_join("labels", ",")).alias("label"), F.get_json_object("props", "$.name").alias("name"), "dst")


@query("dataset_nodes", "SELECT c_mktsegment AS dataset, c_custkey AS id, 'Customer' AS label, c_nationkey AS nation, c_custkey % 5 AS ts FROM customer")
def dataset_nodes(spark, sf_dir):
    """Node tables in packed containers of sixteen sections of a segment, read back; a missing time is 0."""
    c = table(spark, sf_dir, "customer")
    ts = F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") % 5)
    rows = c.select("c_mktsegment", F.col("c_custkey").alias("id"), F.array(F.lit("Customer")).alias("labels"), ts.alias("ts"), F.to_json(F.struct(F.col("c_nationkey").alias("nation"))).alias("props"))
    bodies = D.section_bodies(rows, "c_mktsegment", "node_table", "customer", "id")
    made = bodies.groupBy("c_mktsegment", F.floor(F.col("part") / 16).alias("file")).agg(F.collect_list(F.struct("kind", "name", "body")).alias("s"))
    files = made.select("c_mktsegment", D.container(D.Dataset("customers"), F.col("s"), packed=True).alias("b"))
    sections = files.select(F.col("c_mktsegment"), F.explode(D.container_sections("b")).alias("s")).select(F.col("c_mktsegment").alias("name"), "s.kind", "s.body")
    read = D.section_rows(sections, "node_table")
    return read.select(F.col("name").alias("dataset"), "id", F.element_at("labels", 1).alias("label"), F.get_json_object("props", "$.nation").cast("long").alias("nation"), "ts")


@query("dataset_edges", "SELECT o_orderpriority AS dataset, o_custkey AS src, o_orderkey AS dst, CAST(o_orderkey % 10 AS DOUBLE) AS weight, 0 AS ts FROM orders")
def dataset_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderpriority", F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), (F.col("o_orderkey") % 10).cast("double").alias("weight"))
    bodies = D.section_bodies(rows, "o_orderpriority", "edge_table", "placed", "dst")
    read = D.section_rows(bodies.select(F.col("o_orderpriority").alias("name"), "kind", "body"), "edge_table")
    return read.select(F.col("name").alias("dataset"), "src", "dst", "weight", "ts")



@query("dataset_features", "SELECT c_nationkey AS part, c_custkey AS id, CAST(c_custkey AS DOUBLE) AS first, CAST(c_nationkey AS DOUBLE) AS second FROM customer")
def dataset_features(spark, sf_dir):
    """Row-wise feature sections, one for each nation."""
    c = table(spark, sf_dir, "customer")
    rows = c.select("c_nationkey", F.col("c_custkey").alias("id"), F.array(F.col("c_custkey").cast("double"), F.col("c_nationkey").cast("double")).alias("values"))
    bodies = D.section_bodies(rows, "c_nationkey", "feature", "x", "id", shape=[2], dtype="float64", row_wise=True)
    read = D.section_rows(bodies.select(F.col("c_nationkey").cast("string").alias("name"), "kind", "body"), "feature")
    return read.select(F.col("name").cast("int").alias("part"), "id", F.get("values", 0).alias("first"), F.get("values", 1).alias("second"))


@query("dataset_splits", "SELECT CASE WHEN c_custkey % 10 < 8 THEN 'train' WHEN c_custkey % 10 = 8 THEN 'val' ELSE 'test' END AS part, c_custkey AS id FROM customer")
def dataset_splits(spark, sf_dir):
    """Splits as masks and back."""
    c = table(spark, sf_dir, "customer")
    part = F.when(F.col("c_custkey") % 10 < 8, "train").when(F.col("c_custkey") % 10 == 8, "val").otherwise("test")
    rows = c.select((F.col("c_custkey") * 0).alias("one"), part.alias("part"), F.col("c_custkey").alias("id"))
    bodies = D.section_bodies(rows, "one", "split", "main", "id", n_nodes=10_000_000)
    return D.section_rows(bodies, "split").select("part", "id")


@query("linked_documents", "SELECT n_nationkey, 'https://example.org/nation/' || n_nationkey AS id, 'https://example.org/region/' || n_regionkey AS region, n_name AS name, 2 AS n_iris, 'name' AS term FROM nation")
def linked_documents(spark, sf_dir):
    """Linked-data documents with an IRI table, written and read back."""
    base = "https://example.org/"
    doc = F.concat(F.lit('{"id":{"@id":"' + base + 'nation/'), F.col("n_nationkey").cast("string"), F.lit('"},"region":{"@id":"' + base + 'region/'), F.col("n_regionkey").cast("string"), F.lit('"},"name":"'), "n_name", F.lit('"}'))
    read = table(spark, sf_dir, "nation").select("n_nationkey", L.linked_fields(L.to_linked(doc, [("name", base + "name", 0)])).alias("d"))
    return read.select(
        "n_nationkey",
        F.get_json_object("d.root", "$.id['@id']").alias("id"),
        F.get_json_object("d.root", "$.region['@id']").alias("region"),
        F.get_json_object("d.root", "$.name").alias("name"),
        F.size("d.iris").alias("n_iris"),
        F.get("d.terms", 0)["term"].alias("term"),
    )


@query("hinted_columns", "SELECT event_id, 'k' AS field, 8 AS total_bytes, -1 AS n_rows, 'k,v' AS fields, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS first, 2.0::DOUBLE AS second FROM events")
def hinted_columns(spark, sf_dir):
    """Documents with column hints: dictionary, hints and a tensor column."""
    hints = (W.Hint("k", W.INT, (), 3), W.Hint("v", W.FLOAT, (2,), 4))
    k = F.get_json_object("props", "$.k")
    doc = A.hinted_documents(F.concat(F.lit('{"k":'), k, F.lit(',"v":['), k, F.lit(',2]}')), hints, ("v",))
    read = table(spark, sf_dir, "events").select("event_id", doc.alias("b"))
    read = read.select("event_id", A.document_info("b").alias("i"), A.tensor_column("b", "v").alias("v"))
    hint = F.get("i.hints", 0)
    return read.select("event_id", hint["field"].alias("field"), hint["total_bytes"].alias("total_bytes"), "i.n_rows", F.array_join("i.fields", ",").alias("fields"), F.get("v", 0).alias("first"), F.get("v", 1).alias("second"))


@query("group_varints", "SELECT o_orderkey, o_orderkey AS first, -o_custkey AS second, 0 AS third, 3 AS n FROM orders")
def group_varints(spark, sf_dir):
    made = A.group_varint_bytes(F.array("o_orderkey", -F.col("o_custkey"), F.lit(0)))
    read = table(spark, sf_dir, "orders").select("o_orderkey", A.group_varint_values(made).alias("v"))
    return read.select("o_orderkey", *[F.get("v", i).alias(n) for i, n in enumerate(("first", "second", "third"))], F.size("v").alias("n"))


@query("tensor_views", "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS first, CAST(o_custkey AS DOUBLE) AS second, true AS short_is_null FROM orders")
def tensor_views(spark, sf_dir):
    data = A.tensor_bytes(F.array(F.col("o_orderkey").cast("double"), F.col("o_custkey").cast("double")), "d")
    read = table(spark, sf_dir, "orders").select("o_orderkey", A.tensor_values(data, "d", 2).alias("v"), A.tensor_values(data, "d", 3).alias("w"))
    return read.select("o_orderkey", F.get("v", 0).alias("first"), F.get("v", 1).alias("second"), F.col("w").isNull().alias("short_is_null"))


@query("any_bridge", "SELECT o_orderkey, o_orderkey AS k, o_orderpriority AS p, o_custkey AS second FROM orders")
def any_bridge(spark, sf_dir):
    """Any columns as documents, lists of numbers as tensors, and back."""
    doc = A.any_document(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.array("o_orderkey", "o_custkey").alias("v")))
    back = table(spark, sf_dir, "orders").select("o_orderkey", A.any_json(doc).alias("j"))
    return back.select("o_orderkey", F.get_json_object("j", "$.k").cast("long").alias("k"), F.get_json_object("j", "$.p").alias("p"), F.get_json_object("j", "$.v[1]").cast("long").alias("second"))


@query("typed_getters", "SELECT event_id, event_type AS name, '' AS missing, ['a', event_type] AS tags, 0 AS n_missing, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS FLOAT) AS first FROM events")
def typed_getters(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    doc = F.concat(F.lit('{"name":"'), "event_type", F.lit('","tags":["a",1,"'), "event_type", F.lit('"],"v":['), k, F.lit(",2.5]}"))
    given = table(spark, sf_dir, "events").select("event_id", doc.alias("d"))
    d = F.col("d")
    return given.select(
        "event_id", A.string_at(d, "$.name").alias("name"), A.string_at(d, "$.none").alias("missing"), A.strings_at(d, "$.tags").alias("tags"), F.size(A.strings_at(d, "$.none")).alias("n_missing"), F.get(A.floats_at(d, "$.v"), 0).alias("first")
    )


@query("json_mutators", "SELECT event_id, '{\"a\":2,\"k\":' || CAST(json_extract_string(props, '$.k') AS BIGINT) || ',\"t\":\"' || event_type || '\"}' AS doc, '[1,\"' || event_type || '\"]' AS list, '[7]' AS first FROM events")
def json_mutators(spark, sf_dir):
    """Members are set in their place or at the end; elements are appended."""
    doc = F.concat(F.lit('{"a":1,"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    quoted = F.concat(F.lit('"'), "event_type", F.lit('"'))
    changed = A.with_member(A.with_member(doc, "a", F.lit("2")), "t", quoted)
    return table(spark, sf_dir, "events").select("event_id", changed.alias("doc"), A.with_element(F.lit("[1]"), quoted).alias("list"), A.with_element(F.lit("[ ]"), F.lit("7")).alias("first"))


@query("content_codecs", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'binary' ELSE 'json' END AS codec FROM nation")
def content_codecs(spark, sf_dir):
    kinds = F.array(F.lit("application/json; charset=utf-8"), F.lit("application/x-tessera"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", A.codec_for(F.element_at(kinds, (F.col("n_nationkey") % 3 + 1).cast("int"))).alias("codec"))


@query("registered_decoder", "SELECT o_orderkey, o_orderkey * 2 AS twice, o_orderpriority AS priority FROM orders")
def registered_decoder(spark, sf_dir):
    """A registered function makes rows of a type of decoded values."""
    A.register_decoder("order", lambda v: {"twice": v["k"] * 2, "priority": v["p"]})
    doc = W.to_wire(F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))))
    read = table(spark, sf_dir, "orders").select("o_orderkey", A.decoded_by("order", doc, "struct<twice:bigint,priority:string>").alias("r"))
    return read.select("o_orderkey", "r.*")


@query("static_dictionary", "SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 ELSE -1 END AS slot, CASE WHEN event_type IN ('click', 'purchase') THEN event_type ELSE '' END AS word FROM events")
def static_dictionary(spark, sf_dir):
    words = R.dictionary(spark, ["click", "purchase", "click"])
    coded = R.encoded_words(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", F.broadcast(words))
    return R.decoded_words(coded, "slot", F.broadcast(words)).select("event_id", "slot", "word")


@query("grown_dictionary", "SELECT l AS word, row_number() OVER (ORDER BY min(doc_id), l) - 1 AS slot FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1")
def grown_dictionary(spark, sf_dir):
    """A dictionary of every line by first use: no task holds all of its words."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return R.dictionary_of(lines, "line", "doc_id")


@query("merged_dictionaries", "SELECT 'click' AS word, 0 AS slot UNION ALL SELECT 'view', 1 UNION ALL SELECT 'purchase', 2")
def merged_dictionaries(spark, sf_dir):
    return R.merged_dictionaries(R.dictionary(spark, ["click", "view"]), R.dictionary(spark, ["purchase", "click"]))


@query("scoped_interning", "SELECT 'event_type' AS role, count(*) AS requests, count(DISTINCT event_type) AS \"distinct\", count(*) - count(DISTINCT event_type) AS hits FROM events UNION ALL SELECT 'user_id', count(*), count(DISTINCT user_id), count(*) - count(DISTINCT user_id) FROM events")
def scoped_interning(spark, sf_dir):
    return R.scoped_pool_stats(table(spark, sf_dir, "events"), ["event_type", "user_id"])


@query("schema_contexts", "SELECT n_nationkey, 'name' AS first, 'region' AS second, 'other' AS third, true AS same_id FROM nation")
def schema_contexts(spark, sf_dir):
    """Numeric keys name the keys of a schema line; its id is that of its keys."""
    keys = ["region", "name"]
    identity = R.context_id_of(keys)
    line = table(spark, sf_dir, "nation").select("n_nationkey", R.schema_line(F.lit(identity), F.array(*[F.lit(k) for k in keys])).alias("line"))
    parsed = line.select("n_nationkey", R.schema_line_fields(F.col("line")).alias("s"))
    contexts = spark.createDataFrame([(identity, keys)], "id string, keys array<string>")
    long_ = parsed.select("n_nationkey", "s.id", (R.context_id(F.col("s.keys")) == F.col("s.id")).alias("same_id"), F.posexplode(F.array(F.lit("#1"), F.lit("#0"), F.lit("other"))).alias("at", "key"))
    named = R.resolve_numeric_keys(long_, "key", "id", F.broadcast(contexts))
    return named.groupBy("n_nationkey", "same_id").agg(*[F.max(F.when(F.col("at") == i, F.col("name"))).alias(n) for i, n in enumerate(("first", "second", "third"))])


@query("resident_bases", "SELECT user_id, max(event_id) AS last_use FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def resident_bases(spark, sf_dir):
    """What a store of ten base values holds: the ten used last."""
    events = table(spark, sf_dir, "events")
    stores = events.groupBy("user_id").agg(F.min("event_id").alias("event_id")).withColumn("op", F.lit("store"))
    uses = events.select("user_id", "event_id").withColumn("op", F.lit("touch")).unionByName(stores)
    return R.resident(uses, "user_id", "event_id", "op", 10)


@query("frame_handlers", "SELECT event_id, 'bought' AS what FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, 'clicked' FROM events WHERE event_type = 'click'")
def frame_handlers(spark, sf_dir):
    """One handler for each kind; frames of other kinds are left out."""
    frames = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"))
    named = {"purchase": "bought", "click": "clicked"}
    return R.by_kind(frames, {k: lambda df, v=v: df.select("event_id", F.lit(v).alias("what")) for k, v in named.items()})
