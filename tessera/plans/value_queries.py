"""Queries over nested values and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import canonical, decimals, numeric
from tessera.operators import text as T
from tessera.operators import values as V
from tessera.operators.ranks import ranked
from tessera.plans.catalogue import query
from tessera.session import table


@query("json_typed_projection", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_typed_projection(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", V.typed_field(F.col("props"), "$.k", "bigint")[0].alias("k"))


@query("json_valid_flags", "SELECT event_id, true AS k_valid, false AS text_valid FROM events")
def json_valid_flags(spark, sf_dir):
    """The exact type matters: an integer is no string."""
    props = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", V.typed_field(props, "$.k", "bigint")[1].alias("k_valid"), V.typed_field(props, "$.k", "string")[1].alias("text_valid"))


@query("json_null_drop", "SELECT event_id, CASE WHEN value > 50 THEN '{\"k\":' || CAST(json_extract_string(props, '$.k') AS BIGINT) || ',\"t\":\"' || event_type || '\"}' ELSE '{\"t\":\"' || event_type || '\"}' END AS doc FROM events")
def json_null_drop(spark, sf_dir):
    k = F.when(F.col("value") > 50, F.get_json_object("props", "$.k").cast("long"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("t"))).alias("doc"))


@query("enriched_types", "SELECT 'o_orderdate' AS field, 'datetime' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'o_orderpriority', 'string', count(*) FROM orders")
def enriched_types(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kinds = orders.select(F.explode(F.array(
        F.struct(F.lit("o_orderdate").alias("field"), V.enriched_kind("o_orderdate", day).alias("kind")),
        F.struct(F.lit("o_orderpriority").alias("field"), V.enriched_kind("o_orderpriority", F.col("o_orderpriority")).alias("kind")),
    )).alias("x"))
    return kinds.groupBy("x.field", "x.kind").agg(F.count(F.lit(1)).alias("n"))


@query("schema_drift", "SELECT CASE WHEN event_id % 10 = 0 THEN 'OBJECT<k: STRING>' ELSE 'OBJECT<k: BIGINT>' END AS shape, count(*) AS n FROM events GROUP BY 1")
def schema_drift(spark, sf_dir):
    """A tenth of the writers send the number as text."""
    sent = F.when(F.col("event_id") % 10 == 0, F.regexp_replace("props", r"(\d+)", '"$1"')).otherwise(F.col("props"))
    return V.drift(table(spark, sf_dir, "events").select(sent.alias("props")), "props")


@query("column_stats", "SELECT 'value' AS field, count(*) AS n_rows, count(CASE WHEN value > 50 THEN 1 END) AS n_valid, count(*) - count(CASE WHEN value > 50 THEN 1 END) AS n_null FROM events UNION ALL SELECT 'user_id', count(*), count(user_id), count(*) - count(user_id) FROM events")
def column_stats(spark, sf_dir):
    given = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return V.column_stats(given, ["value", "user_id"])


@query("content_ids", "SELECT DISTINCT 'sha256:' || sha256(text) AS cid, strlen(text) AS size FROM documents")
def content_ids(spark, sf_dir):
    return V.blob_store(table(spark, sf_dir, "documents"), "text")


@query("crc32_check", "SELECT doc_id, strlen(text) AS n_bytes FROM documents")
def crc32_check(spark, sf_dir):
    """Checksums survive a round trip of the text through base64; rows that do not are left out."""
    text = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").where(F.crc32(text) == F.crc32(F.unbase64(F.base64(text)))).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


@query("bitmask_members", "SELECT p_partkey, i AS slot FROM part, range(0, 6) t(i) WHERE (p_size >> i) & 1 = 1")
def bitmask_members(spark, sf_dir):
    mask = F.unhex(F.lpad(F.hex("p_size"), 2, "0"))
    listed = table(spark, sf_dir, "part").select("p_partkey", F.explode(numeric.mask_members(mask)).alias("slot"))
    return listed.withColumn("slot", F.col("slot").cast("long"))


@query("token_estimate", "SELECT doc_id, (strlen(text) + 3) // 4 AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("string_pool", "SELECT value, n, row_number() OVER (ORDER BY n DESC, strlen(value) DESC, value) - 1 AS slot FROM (SELECT line AS value, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE strlen(line) >= 20 GROUP BY 1 HAVING count(*) >= 2) QUALIFY slot < 50")
def string_pool(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return T.string_pool(lines, "line", limit=50)


LONG = "l AS (SELECT text, min(doc_id) AS first FROM documents WHERE strlen(text) >= 50 GROUP BY 1 HAVING count(*) > 1), r AS (SELECT *, row_number() OVER (ORDER BY first) - 1 AS k FROM l)"


@query("online_intern", f"WITH {LONG} SELECT doc_id, CASE WHEN doc_id > first THEN k // 256 END AS pool, CASE WHEN doc_id > first THEN k % 256 END AS slot FROM documents d LEFT JOIN r ON r.text = d.text")
def online_intern(spark, sf_dir):
    return T.interned(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "pool", "slot")


@query("intern_stats", "SELECT count(*) AS requests, count(DISTINCT event_type) AS misses, count(*) - count(DISTINCT event_type) AS hits, (count(*) - count(DISTINCT event_type)) / count(*) AS hit_rate FROM events")
def intern_stats(spark, sf_dir):
    return T.pool_stats(table(spark, sf_dir, "events"), "event_type")


@query("key_dictionary", "SELECT event_type AS key, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS slot, count(*) AS uses FROM events GROUP BY 1")
def key_dictionary(spark, sf_dir):
    return T.key_dictionary(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("tabular_emit", "SELECT n_regionkey, '@tab _ rows=' || count(*) || ' cols=2 [n_nationkey n_name]' || chr(10) || string_agg('|' || n_nationkey || '|' || n_name || '|', chr(10) ORDER BY n_nationkey) || chr(10) || '@end' AS text FROM nation GROUP BY 1")
def tabular_emit(spark, sf_dir):
    return T.tabular_lines(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"])


@query(
    "tabular_detect",
    """WITH f AS (SELECT user_id, event_id, list_filter(['event_type', CASE WHEN value > 50 THEN 'value' END, CASE WHEN value > 95 THEN 'rare' END], lambda x: x IS NOT NULL) AS fields FROM events),
    s AS (SELECT user_id, f, count(*) AS n FROM (SELECT user_id, unnest(fields) AS f FROM f) GROUP BY 1, 2), r AS (SELECT user_id, count(*) AS n_rows FROM f GROUP BY 1)
    SELECT user_id, n_rows, count(*) FILTER (n = n_rows) AS n_common, count(*) AS n_union, n_rows >= 3 AND count(*) <= 64 AND 2 * count(*) FILTER (n = n_rows) >= count(*) AS tabular FROM r JOIN s USING (user_id) GROUP BY 1, 2""",
)
def tabular_detect(spark, sf_dir):
    fields = F.array_compact(F.array(F.lit("event_type"), F.when(F.col("value") > 50, "value"), F.when(F.col("value") > 95, "rare")))
    return T.is_tabular(table(spark, sf_dir, "events").select("user_id", fields.alias("fields")), "user_id", "fields")


@query("relation_names", "SELECT page_id, CASE WHEN x = '' THEN 'UNKNOWN' WHEN regexp_matches(x, '^[0-9]') THEN '_' || x ELSE x END AS relation FROM (SELECT page_id, regexp_replace(regexp_extract(url, '([^/#]*)$', 1), '[^A-Za-z0-9_]', '_', 'g') AS x FROM pages)")
def relation_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.relation_of(F.col("url")).alias("relation"))


@query("iri_dictionary", "SELECT c_mktsegment AS iri, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS slot FROM customer GROUP BY 1")
def iri_dictionary(spark, sf_dir):
    first = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("iri")).agg(F.min("c_custkey").alias("first"))
    return ranked(first, ["first"], "slot").select("iri", "slot")


@query("conversation_turns", "SELECT conv_id, count(*) AS turns, sum((strlen(text) + 3) // 4)::BIGINT AS tokens FROM conversations GROUP BY 1")
def conversation_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(T.estimated_tokens(F.col("text"))).alias("tokens"))


@query("decimal_sums", "SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total, CAST(max(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS most FROM orders GROUP BY 1")
def decimal_sums(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum(price).cast("string").alias("total"), F.max(price).cast("string").alias("most"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"name":"'), "event_type", F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit(',"nothing":null,"list":[true,"a b"]}'))
    return table(spark, sf_dir, "events").select("event_id", text.alias("doc"))


CANON = "'{k=' || CAST(json_extract_string(props, '$.k') AS BIGINT) || ' list=[t \"a b\"] name=' || event_type || ' nothing=_}'"


@query("canonical_text", f"SELECT event_id, {CANON} AS text FROM events")
def canonical_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("event_id", canonical.canonical_text("doc").alias("text"))


@query("canonical_fingerprints", f"SELECT sha256({CANON}) AS fingerprint, count(*) AS n FROM events GROUP BY 1")
def canonical_fingerprints(spark, sf_dir):
    return _documents(spark, sf_dir).groupBy(canonical.fingerprint("doc").alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))


@query("abbreviated_keys", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'p' WHEN 'click' THEN 'c' ELSE event_type END AS short FROM events")
def abbreviated_keys(spark, sf_dir):
    """A two-way dictionary as a map literal; names it does not know stay."""
    known = F.create_map(*[F.lit(x) for x in ("purchase", "p", "click", "c")])
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(known, F.col("event_type")), F.col("event_type")).alias("short"))


@query("allow_list", "SELECT event_id FROM events WHERE event_type IN ('click', 'purchase')")
def allow_list(spark, sf_dir):
    allowed = spark.createDataFrame([("click",), ("purchase",)], "event_type string")
    return table(spark, sf_dir, "events").join(F.broadcast(allowed), "event_type", "left_semi").select("event_id")


@query("label_filter", "SELECT n_nationkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def label_filter(spark, sf_dir):
    labelled = table(spark, sf_dir, "customer").withColumn("labels", F.array("c_mktsegment"))
    return labelled.where(F.array_contains("labels", "BUILDING")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))


@query("pool_resolution", "SELECT o_orderkey, o_orderpriority AS value FROM orders")
def pool_resolution(spark, sf_dir):
    """References into a string pool and back: a reference without an entry would be lost and differ from the source."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    pool = T.string_pool(orders, "o_orderpriority", min_bytes=1).select("value", "slot")
    coded = orders.join(F.broadcast(pool), F.col("o_orderpriority") == F.col("value")).select("o_orderkey", "slot")
    return coded.join(F.broadcast(pool), "slot").select("o_orderkey", "value")


@query("neighbours_of", "SELECT DISTINCT b.l_suppkey AS id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey WHERE a.l_suppkey = 1")
def neighbours_of(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    mine = lines.where("l_suppkey = 1").select("l_orderkey")
    return lines.join(mine, "l_orderkey", "left_semi").where("l_suppkey <> 1").select(F.col("l_suppkey").alias("id")).distinct()


@query("rdf_terms", "SELECT n_nationkey, 'https://example.org/nation/' || n_nationkey AS subject, 'https://example.org/name' AS predicate, n_name AS object, 'literal' AS kind FROM nation")
def rdf_terms(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        "n_nationkey",
        F.concat(F.lit("https://example.org/nation/"), F.col("n_nationkey").cast("string")).alias("subject"),
        F.lit("https://example.org/name").alias("predicate"),
        F.col("n_name").alias("object"),
        F.lit("literal").alias("kind"),
    )


@query("cypher_statements", "SELECT n_nationkey, 'MERGE (n:Nation {id: $id}) SET n.name = $name' AS statement, to_json({'id': n_nationkey, 'name': n_name})::VARCHAR AS parameters FROM nation")
def cypher_statements(spark, sf_dir):
    parameters = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.lit("MERGE (n:Nation {id: $id}) SET n.name = $name").alias("statement"), parameters.alias("parameters"))


@query("node_table", "SELECT c_custkey AS id, c_nationkey AS type, count(*) OVER (PARTITION BY c_nationkey) AS type_size FROM customer")
def node_table(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("type"), F.count(F.lit(1)).over(Window.partitionBy("c_nationkey")).alias("type_size")
    )


@query("dataset_counts", "SELECT type, n, CAST(sum(n) OVER (ORDER BY type) - n AS BIGINT) AS first_id FROM (SELECT c_nationkey AS type, count(*) AS n FROM customer GROUP BY 1)")
def dataset_counts(spark, sf_dir):
    """Contiguous id spaces of node types: a running sum over one row for each type."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("first_id", (F.sum("n").over(Window.orderBy("type")) - F.col("n")).cast("long"))


@query("metadata_sections", "SELECT 'nodes' AS kind, 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'edges', 'orders', count(*) FROM orders UNION ALL SELECT 'features', 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'labels', 'labels', count(*) FROM labels")
def metadata_sections(spark, sf_dir):
    parts = [("nodes", "customer"), ("edges", "orders"), ("features", "embeddings"), ("labels", "labels")]
    counts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), F.lit(t).alias("name"), "n") for k, t in parts]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])


PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"


@query("decimal_arithmetic", f"SELECT o_orderkey, CAST({PRICE} + 1.25 AS VARCHAR) AS plus, CAST({PRICE} - 0.05 AS VARCHAR) AS minus, CAST({PRICE} * 2.5 AS VARCHAR) AS times, CASE WHEN {PRICE} < 100000 THEN -1 WHEN {PRICE} > 100000 THEN 1 ELSE 0 END AS cmp FROM orders")
def decimal_arithmetic(spark, sf_dir):
    text = F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("m"))
    price = decimals.from_literal(text, 2).cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (price + F.lit("1.25").cast("decimal(3,2)")).cast("string").alias("plus"),
        (price - F.lit("0.05").cast("decimal(3,2)")).cast("string").alias("minus"),
        (price * F.lit("2.5").cast("decimal(2,1)")).cast("string").alias("times"),
        decimals.compare(price, F.lit(100000).cast("decimal(18,2)")).alias("cmp"),
    )


@query("datetime_nanos", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) % 1000000 * 1000 + event_id % 1000 AS VARCHAR), 9, '0') || 'Z' AS text FROM events")
def datetime_nanos(spark, sf_dir):
    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    return table(spark, sf_dir, "events").select("event_id", decimals.rfc3339_of_nanos(nanos).alias("text"))
