"""Retrieval queries: vectors from ``embeddings`` beside a graph of consecutive vector ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.plans.catalogue import query
from tessera.session import table

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
NORM = "sqrt(list_sum(list_transform({a}, lambda p: p::DOUBLE * p::DOUBLE)))"
COS = f"{DOT} / ({NORM.format(a='{a}')} * {NORM.format(a='{b}')})"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("community"))


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector cites the two before it."""
    v = vectors(spark, sf_dir).select(F.col("id").alias("src"))
    return v.select("src", F.explode(F.array(F.col("src") - 1, F.col("src") - 2)).alias("dst")).where("dst >= 0")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty neighbours of each queried vector with a graph score and a community."""
    v = vectors(spark, sf_dir)
    near = R.nearest(v.where("id % 50 = 0"), v, 20).withColumnRenamed("score", "vector_score")
    nodes = v.select("id", (1.0 / (1 + F.col("id") % 10)).alias("score"))
    return R.graph_scores(near, nodes).join(v.select("id", "community"), "id")


CANDIDATES = f"""near AS MATERIALIZED (SELECT query, id, score, rank FROM (SELECT q.vec_id AS query, e.vec_id AS id, {COS.format(a='q.embedding', b='e.embedding')} AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.format(a='q.embedding', b='e.embedding')} DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 20),
cand AS MATERIALIZED (SELECT query, near.id, score AS vector_score, (1.0::DOUBLE / (1 + near.id % 10)) / max(1.0::DOUBLE / (1 + near.id % 10)) OVER (PARTITION BY query) AS graph_score, label AS community, rank FROM near JOIN embeddings ON vec_id = near.id)"""


@query("cosine_top_k", f"WITH {CANDIDATES} SELECT query, id, round(score, 5) AS score, rank FROM near")
def cosine_top_k(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return R.nearest(v.where("id % 50 = 0"), v, 20).select("query", "id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("graph_scores", f"WITH {CANDIDATES} SELECT query, id, round(graph_score, 6) AS graph_score FROM cand")
def graph_scores(spark, sf_dir):
    return candidates(spark, sf_dir).select("query", "id", F.round("graph_score", 6).alias("graph_score"))


ALPHA = f"""WITH {CANDIDATES}, b AS (SELECT *, (0.7 * vector_score + 0.3 * graph_score) * CASE WHEN community >= 0 THEN 1.2 ELSE 1 END AS base FROM cand WHERE vector_score >= 0 AND graph_score >= 0),
f AS (SELECT *, CASE WHEN community <> first_value(community) OVER (PARTITION BY query ORDER BY base DESC, id) THEN base / 1.2 ELSE base END AS final FROM b)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.alpha_fusion(candidates(spark, sf_dir), 0.7)


@query("alpha_fusion", ALPHA + " SELECT query, id, round(final, 5) AS final FROM f")
def alpha_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("query", "id", F.round("final", 5).alias("final"))


RRF = "1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query ORDER BY vector_score DESC, id)) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query ORDER BY graph_score DESC, id))"


@query("rrf_fusion", f"WITH {CANDIDATES} SELECT query, id, round({RRF}, 8) AS final FROM cand")
def rrf_fusion(spark, sf_dir):
    return R.rank_fusion(candidates(spark, sf_dir)).select("query", "id", F.round("final", 8).alias("final"))


SCALED = "CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 1 END"


@query("weighted_fusion", f"WITH {CANDIDATES} SELECT query, id, round((0.6 * {SCALED.format(c='vector_score')} + 0.4 * {SCALED.format(c='graph_score')}) / 1.0, 5) AS final FROM cand WINDOW w AS (PARTITION BY query)")
def weighted_fusion(spark, sf_dir):
    return R.weighted_fusion(candidates(spark, sf_dir), 0.6, 0.4).select("query", "id", F.round("final", 5).alias("final"))


@query("min_max_scores", f"WITH {CANDIDATES} SELECT query, id, round({SCALED.format(c='vector_score')}, 5) AS vector_score FROM cand WINDOW w AS (PARTITION BY query)")
def min_max_scores(spark, sf_dir):
    return R.min_max(candidates(spark, sf_dir), "vector_score").select("query", "id", F.round("vector_score", 5).alias("vector_score"))


DIVERSE = ALPHA + ", k AS (SELECT *, row_number() OVER (PARTITION BY query, community ORDER BY final DESC, id) AS p FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY final DESC, id) AS place FROM k WHERE p <= 2)"


@query("diverse_top_k", DIVERSE + " SELECT query, id, place AS rank FROM r WHERE place <= 5")
def diverse_top_k(spark, sf_dir):
    return R.diverse_top_k(fused(spark, sf_dir).drop("rank"), 5, 2).select("query", "id", F.col("rank").cast("long").alias("rank"))


@query(
    "expand_neighbours",
    DIVERSE
    + """, top AS (SELECT query, id, place AS rank, final FROM r WHERE place <= 5),
    n AS (SELECT top.query, x.dst AS id, min(rank) AS rank FROM top, LATERAL (SELECT unnest([top.id - 1, top.id - 2]) AS dst) x WHERE x.dst >= 0 AND NOT EXISTS (SELECT 1 FROM top o WHERE o.query = top.query AND o.id = x.dst) GROUP BY 1, 2)
    SELECT query, id, place FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY rank, id) AS place FROM n) WHERE place <= 3""",
)
def expand_neighbours(spark, sf_dir):
    top = R.diverse_top_k(fused(spark, sf_dir).drop("rank"), 5, 2)
    return R.expand(top, ring(spark, sf_dir), 3).select("query", "id", F.col("place").cast("long").alias("place"))


RING = "ring AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.embedding AS ea, b.embedding AS eb FROM embeddings a JOIN embeddings b ON b.vec_id IN (a.vec_id - 1, a.vec_id - 2))"
RAW = f"raw AS (SELECT src, dst, greatest({COS.format(a='ea', b='eb')}, 0) AS raw FROM ring)"


@query("attention_weights", f"WITH {RING}, {RAW} SELECT src, dst, round(CASE WHEN sum(raw) OVER w > 0 THEN raw / sum(raw) OVER w ELSE 1.0 / count(*) OVER w END, 4) AS weight FROM raw WINDOW w AS (PARTITION BY src)")
def attention_weights(spark, sf_dir):
    return R.attention(ring(spark, sf_dir), vectors(spark, sf_dir)).select("src", "dst", F.round("weight", 4).alias("weight"))


@query("attention_top_edges", f"WITH {RING}, {RAW} SELECT src, dst, round(raw * 3.95 / 4, 4) AS mean FROM raw ORDER BY raw * 3.95 / 4 DESC, src, dst LIMIT 20")
def attention_top_edges(spark, sf_dir):
    heads = R.attention_heads(ring(spark, sf_dir), vectors(spark, sf_dir))
    return heads.orderBy(F.desc("mean"), "src", "dst").limit(20).select("src", "dst", F.round("mean", 4).alias("mean"))


@query("link_scores", f"WITH {RING} SELECT src, dst, round(1 / (1 + exp(-({DOT.format(a='ea', b='eb')}))), 4) AS score FROM ring")
def link_scores(spark, sf_dir):
    return R.link_scores(ring(spark, sf_dir), vectors(spark, sf_dir)).select("src", "dst", F.round("score", 4).alias("score"))


@query("row_l2_normalise", f"SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda p: p::DOUBLE)) / {NORM.format(a='embedding')}, 4) AS total FROM embeddings")
def row_l2_normalise(spark, sf_dir):
    scaled = R.l2_normalised(vectors(spark, sf_dir), "vector")
    return scaled.select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("score_classes", "SELECT vec_id AS id, CAST(floor((vec_id - min(vec_id) OVER ()) / (max(vec_id) OVER () - min(vec_id) OVER ())::DOUBLE * 6) AS BIGINT) AS class FROM embeddings")
def score_classes(spark, sf_dir):
    return R.score_classes(vectors(spark, sf_dir).select("id", F.col("id").cast("double").alias("score")), 7).select("id", "class")


NEIGHBOUR_SUM = "list_sum(list_transform({a}, lambda p: p::DOUBLE))"


@query(
    "gat_fallback",
    f"""WITH {RING}, {RAW}, w AS (SELECT src, dst, CASE WHEN sum(raw) OVER w > 0 THEN raw / sum(raw) OVER w ELSE 1.0 / count(*) OVER w END AS weight FROM raw WINDOW w AS (PARTITION BY src)),
    n AS (SELECT w.src, sum(w.weight * {NEIGHBOUR_SUM.format(a='e.embedding')}) AS total FROM w JOIN embeddings e ON e.vec_id = w.dst GROUP BY 1)
    SELECT vec_id AS id, round(0.7 * (0.5 * {NEIGHBOUR_SUM.format(a='embedding')} + 0.5 * coalesce(n.total, 0)) + 0.3 * 100 / (1 + vec_id % 10), 3) AS score FROM embeddings LEFT JOIN n ON n.src = vec_id""",
)
def gat_fallback(spark, sf_dir):
    v = vectors(spark, sf_dir)
    ranks = v.select("id", (1.0 / (1 + F.col("id") % 10)).alias("score"))
    return R.attention_fallback(ring(spark, sf_dir), v, ranks, 7).select("id", F.round("score", 3).alias("score"))


@query("softmax_classes", "SELECT vec_id AS id, CAST(list_position(embedding[1:4], list_max(embedding[1:4])) - 1 AS BIGINT) AS class, round(1 / list_sum(list_transform(embedding[1:4], lambda x: exp(x::DOUBLE - list_max(embedding[1:4])::DOUBLE))), 5) AS confidence FROM embeddings")
def softmax_classes(spark, sf_dir):
    logits = vectors(spark, sf_dir).select("id", F.slice("vector", 1, 4).cast("array<double>").alias("logits"))
    return R.softmax_classes(logits, "logits").select("id", F.col("class"), F.round("confidence", 5).alias("confidence"))


@query("sparsity_ratio", "SELECT vec_id, len(embedding) >= 16 AND len(list_filter(embedding, lambda x: abs(x) < 0.05)) > 0.4 * len(embedding) AS sparse, len(list_filter(embedding, lambda x: abs(x) < 0.05)) AS zeros, 8 * len(list_filter(embedding, lambda x: abs(x) >= 0.05)) + 32 AS sparse_bytes FROM embeddings")
def sparsity_ratio(spark, sf_dir):
    from tessera.functions import numeric

    return numeric.sparsity(table(spark, sf_dir, "embeddings"), "embedding", 0.05).select("vec_id", "sparse", "zeros", "sparse_bytes")


@query("coo_explode", "SELECT vec_id, i - 1 AS slot, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, range(1, 65) t(i) WHERE abs(embedding[i]) >= 0.05")
def coo_explode(spark, sf_dir):
    from tessera.functions import numeric

    return numeric.to_coo(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.05).select("vec_id", "slot", F.round(F.col("value").cast("double"), 6).alias("value"))
