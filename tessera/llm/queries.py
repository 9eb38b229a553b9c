"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.byte_cnn import quality_scores
from tessera.llm.common import crc32_text, text_of
from tessera.llm.compact_windows import near_passages
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.lsh_forest import ngram_classes
from tessera.llm.mixing import poisson_mix
from tessera.llm.packing import packed_pieces
from tessera.llm.quality_rules import quality_rules
from tessera.llm.sharding import stratified_shards
from tessera.llm.suffix_dedup import suffix_dedup
from tessera.llm.token_files import read_token_files, write_token_files
from tessera.session import table

N_SHARDS = 24


def op1_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by proportional stratified interleaving (law: rows)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    shards = stratified_shards(docs, N_SHARDS)
    return shards.select(
        "doc_id",
        (F.octet_length(text_of()) + 8).cast("long").alias("size"),
        crc32_text().alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_ngram_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents; documents labelled as good are the trusted target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(docs, trusted).drop("text")


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents at temperature 0.5, one row for each copy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return poisson_mix(docs).select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), "copies", "copy")


def op4_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packed_pieces(docs, 1024)
    return pieces.select(
        "doc_id", F.col("piece_start").alias("start"), "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by the byte-level network."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_scores(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings of all documents, and what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs, columns=["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate passages of all documents."""
    return near_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as Simple-8b token files in doc_id order and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_token_files(write_token_files(docs), with_ids=False)


def op9_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents, with the number of links of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_classes(docs).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op10_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact deduplication of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


# The checksum is folded byte by byte over a table that its polynomial makes.
OP1_SQL = r"""
WITH tab AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
d AS (SELECT doc_id, coalesce(text, '') AS body, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS stratum, md5('17:' || CAST(doc_id AS VARCHAR)) AS shuffle FROM documents),
sums AS (SELECT doc_id, strlen(body) + 8 AS size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))),
  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS text_crc32 FROM (SELECT *, hex(encode(body)) AS h FROM d), tab),
r AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY shuffle, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM d),
p AS (SELECT doc_id, row_number() OVER (ORDER BY (rank + CAST(0.5 AS DOUBLE)) / n, stratum, rank) - 1 AS pos, count(*) OVER () // 24 AS small, count(*) OVER () % 24 AS wide FROM r),
s AS (SELECT doc_id, pos, small, wide, CASE WHEN pos < wide * (small + 1) THEN pos // (small + 1) ELSE wide + (pos - wide * (small + 1)) // greatest(small, 1) END AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(pos - (shard * small + least(shard, wide)) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s JOIN sums USING (doc_id)
"""

OP3_SQL = """
WITH sizes AS (SELECT coalesce(source, '') AS stratum, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY 1),
rates AS (SELECT stratum, (SELECT sum(n) FROM sizes) * w / (SELECT sum(w) FROM sizes) / n AS rate FROM sizes),
cdf AS (SELECT stratum, k, sum(exp(k * ln(rate) - lgamma(k + 1) - rate)) OVER (PARTITION BY stratum ORDER BY k) AS c
        FROM rates, range(0, 400) t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 12)),
drawn AS (SELECT doc_id, source, strlen(text) AS n_bytes, coalesce(source, '') AS stratum,
          CAST('0x' || substr(md5('29:' || md5(CAST(doc_id AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT d.doc_id, d.source, d.n_bytes, (SELECT count(*) FROM cdf c WHERE c.stratum = d.stratum AND c.c <= d.u) AS copies FROM drawn d)
SELECT doc_id, source, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(copies AS INTEGER) AS copies, CAST(unnest(range(0, copies)) AS INTEGER) AS copy
FROM counted
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))
     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS MATERIALIZED (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY 1),
s AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM s JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE shared >= 0.8 * (p.n + q.n - shared) - 1e-9
     UNION ALL SELECT p.doc_id, q.doc_id FROM n p JOIN n q ON p.n = 0 AND q.n = 0 AND p.doc_id <> q.doc_id),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, (SELECT min(b) FROM r WHERE r.a = doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.a = doc_id) AS n_links FROM n
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY sha ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER (PARTITION BY sha ORDER BY chars DESC, doc_id) = 1 AS kept,
       sha AS text_sha256
FROM d
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_stratified_shards": op1_stratified_shards,
        "op2_ngram_likelihood": op2_ngram_likelihood,
        "op3_poisson_mix": op3_poisson_mix,
        "op4_concat_and_cut": op4_concat_and_cut,
        "op5_byte_cnn": op5_byte_cnn,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_compact_windows": op7_compact_windows,
        "op8_simple8b_files": op8_simple8b_files,
        "op9_lsh_forest_join": op9_lsh_forest_join,
        "op10_bloom_exact_dedup": op10_bloom_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_stratified_shards": OP1_SQL, "op3_poisson_mix": OP3_SQL, "op9_lsh_forest_join": OP9_SQL, "op10_bloom_exact_dedup": OP10_SQL}
