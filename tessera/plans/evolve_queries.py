"""Diff, patch, evolution and validation queries: two versions of the customers, and rules over orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evolve as E
from tessera.plans.catalogue import query
from tessera.session import table

COLUMNS = ["c_name", "c_nationkey", "c_mktsegment"]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as they were."""
    return table(spark, sf_dir, "customer").select("c_custkey", *COLUMNS)


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as they are: some moved, some lost their segment, some names are gone or new."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(key % 11 != 0, F.col("c_name")).alias("c_name"),
        F.when(key % 3 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey")).alias("c_nationkey"),
        F.when(key % 7 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )


def base_fields(spark, sf_dir):
    return E.to_fields(base(spark, sf_dir).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))), "c_custkey", COLUMNS)


def target_fields(spark, sf_dir):
    return E.to_fields(target(spark, sf_dir), "c_custkey", COLUMNS)


FIELDS = """b AS (SELECT c_custkey, unnest(['c_name', 'c_nationkey', 'c_mktsegment']) AS field, unnest([c_name, CAST(c_nationkey AS VARCHAR), CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END]) AS value FROM customer),
t AS (SELECT c_custkey, unnest(['c_name', 'c_nationkey', 'c_mktsegment']) AS field, unnest([CASE WHEN c_custkey % 11 <> 0 THEN c_name END,
CAST(CASE WHEN c_custkey % 3 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS VARCHAR), CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END]) AS value FROM customer),
d AS (SELECT c_custkey, field, CASE WHEN b.value IS NULL THEN 'add' WHEN t.value IS NULL THEN 'delete' ELSE 'set' END AS op, t.value AS value FROM b JOIN t USING (c_custkey, field) WHERE b.value IS DISTINCT FROM t.value)"""


@query("record_diff", f"WITH {FIELDS} SELECT * FROM d")
def record_diff(spark, sf_dir):
    return E.diff(base_fields(spark, sf_dir), target_fields(spark, sf_dir), "c_custkey")


@query("diff_stats", f"WITH {FIELDS} SELECT count(*) FILTER (op = 'add') AS added, count(*) FILTER (op = 'delete') AS removed, count(*) FILTER (op = 'set') AS changed FROM d")
def diff_stats(spark, sf_dir):
    return E.diff_stats(record_diff(spark, sf_dir))


@query("apply_delta", f"WITH {FIELDS} SELECT * FROM t WHERE value IS NOT NULL")
def apply_delta(spark, sf_dir):
    return E.apply_changes(base_fields(spark, sf_dir), record_diff(spark, sf_dir), "c_custkey")


@query(
    "apply_patch",
    """WITH s AS (SELECT user_id, event_type AS path, max(event_id) FILTER (event_id % 7 IN (0, 1)) AS fresh_at FROM events GROUP BY 1, 2),
    o AS (SELECT user_id, event_type AS path, event_id AS seq, CASE event_id % 7 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '~' END AS op, floor(value) AS v FROM events),
    m AS (SELECT o.*, fresh_at FROM o JOIN s USING (user_id, path) WHERE fresh_at IS NULL OR seq >= fresh_at),
    f AS (SELECT user_id, path, max(v) FILTER (op = '=') AS base, count(*) FILTER (op <> '~') AS fresh, sum(v) FILTER (op = '~') AS more FROM m GROUP BY 1, 2)
    SELECT user_id, path, round(coalesce(CASE WHEN fresh > 0 THEN base ELSE 100 END, 0) + coalesce(more, 0), 4) AS value FROM f WHERE more IS NOT NULL OR fresh = 0 OR base IS NOT NULL""",
)
def apply_patch(spark, sf_dir):
    """Numeric patches: every seventh event sets, the next deletes, the others add; each path starts at 100."""
    events = table(spark, sf_dir, "events")
    start = events.select("user_id", F.col("event_type").alias("path")).distinct().withColumn("value", F.lit("100"))
    op = F.when(F.col("event_id") % 7 == 0, "=").when(F.col("event_id") % 7 == 1, "-").otherwise("~")
    ops = events.select("user_id", F.col("event_type").alias("path"), F.col("event_id").alias("seq"), op.alias("op"), F.floor("value").cast("string").alias("value"))
    return E.apply_patch(start, ops, "user_id").withColumn("value", F.round(F.col("value").cast("double"), 4))


SCHEMA = E.VersionedSchema(
    "customer",
    ["1.0", "1.1", "2.0"],
    [
        E.EvolvingField("c_custkey", "bigint", required=True),
        E.EvolvingField("c_name", "string", deprecated_in="2.0"),
        E.EvolvingField("c_mktsegment", "string", pattern="^[A-Z]+$"),
        E.EvolvingField("tier", "string", added_in="1.1", default="standard"),
        E.EvolvingField("segment", "string", added_in="2.0", renamed_from="c_mktsegment", required=True),
    ],
)


@query("migrate_versions", "SELECT c_custkey, c_name, 'standard' AS tier, c_mktsegment AS segment FROM customer")
def migrate_versions(spark, sf_dir):
    return SCHEMA.migrate(base(spark, sf_dir), "1.0", "2.0")


@query("field_availability", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{v}', {str(a).lower()}, {str(d).lower()})" for f, v, a, d in SCHEMA.availability()) + ") t(field, version, available, deprecated)")
def field_availability(spark, sf_dir):
    return spark.createDataFrame(SCHEMA.availability(), "field string, version string, available boolean, deprecated boolean")


@query("schema_changelog", "SELECT * FROM (VALUES ('1.0', 'added', 'c_custkey'), ('1.0', 'added', 'c_name'), ('1.0', 'added', 'c_mktsegment'), ('1.1', 'added', 'tier'), ('2.0', 'deprecated', 'c_name'), ('2.0', 'renamed', 'segment')) t(version, change, field)")
def schema_changelog(spark, sf_dir):
    return spark.createDataFrame(SCHEMA.changelog(), "version string, change string, field string")


@query("version_order", "SELECT a, b, CASE WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END AS cmp FROM (SELECT c_nationkey || '.' || c_custkey % 13 AS a, c_custkey % 20 || '.' || c_custkey % 5 || '.1' AS b, [c_nationkey, c_custkey % 13, 0] AS x, [c_custkey % 20, c_custkey % 5, 1] AS y FROM customer)")
def version_order(spark, sf_dir):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    pairs = table(spark, sf_dir, "customer").select(
        F.concat_ws(".", nation.cast("string"), (key % 13).cast("string")).alias("a"), F.concat_ws(".", (key % 20).cast("string"), (key % 5).cast("string"), F.lit("1")).alias("b")
    )
    return pairs.select("a", "b", E.compare_versions(F.col("a"), F.col("b")).alias("cmp"))


RULES = [
    E.Rule("o_totalprice", "range", (1000.0, 400000.0)),
    E.Rule("o_orderstatus", "enum", ("O", "F")),
    E.Rule("o_orderpriority", "regex", "^[1-4]-"),
    E.Rule("o_orderpriority", "max_len", 9),
    E.Rule("o_custkey", "min", 10),
]


@query(
    "validate_rules",
    """SELECT o_orderkey, 'o_totalprice' AS field, 'range' AS rule FROM orders WHERE NOT o_totalprice BETWEEN 1000 AND 400000
    UNION ALL SELECT o_orderkey, 'o_orderstatus', 'enum' FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT o_orderkey, 'o_orderpriority', 'regex' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')
    UNION ALL SELECT o_orderkey, 'o_orderpriority', 'max_len' FROM orders WHERE strlen(o_orderpriority) > 9 UNION ALL SELECT o_orderkey, 'o_custkey', 'min' FROM orders WHERE o_custkey < 10""",
)
def validate_rules(spark, sf_dir):
    return E.violations(table(spark, sf_dir, "orders"), "o_orderkey", RULES)


@query("unique_rule", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_rule(spark, sf_dir):
    return E.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("schema_errors", "SELECT c_custkey, CASE WHEN c_mktsegment IS NULL THEN 'required_field:segment' END AS error FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer) WHERE c_mktsegment IS NULL")
def schema_errors(spark, sf_dir):
    old = base(spark, sf_dir).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    new = SCHEMA.migrate(old, "1.0", "2.0")
    return new.select("c_custkey", F.explode(SCHEMA.errors(new, "2.0")).alias("error"))
