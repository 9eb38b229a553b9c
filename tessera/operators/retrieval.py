"""Vector and graph retrieval: similarity, fusion, expansion and diversification of ranked lists.

Vectors are array columns and all arithmetic is in doubles, within generated code.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length of an array of numbers."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where lengths differ or a norm is 0."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def l2_normalised(df: DataFrame, column: str) -> DataFrame:
    """Rows with the array scaled to length 1; a zero vector stays."""
    length = norm(F.col(column))
    return df.withColumn(column, F.transform(column, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double"))))


#: Bytes of query vectors that one broadcast holds, and scores that a task has at once.
MAX_BROADCAST_BYTES, MAX_SCORES = 64 << 20, 4_000_000


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "id", vector: str = "vector", max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(query, id, score, rank): the k most similar vectors of each query, itself left out, ties by id.

    The query set meets all vectors in blocks of at most ``max_bytes``, one after another where it is larger.  Matrix
    products, whose sums run in another order, tell which vectors can be among a task's k best; these are scored as
    ``dot`` and ``norm`` score them, and each task sends k rows a query through the shuffle.
    """
    spark = queries.sparkSession
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("width")).first()
    per_block = max(1, max_bytes // (8 * max(size["width"] or 1, 1) + 64))
    blocks = max(1, -(-size["n"] * 5 // (4 * per_block))) if size["n"] > per_block else 1  # hashed blocks are uneven: a quarter of room
    q = queries.select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("_q"))
    v = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("_v")).where("_v is not null")
    fields = [T.StructField("query", q.schema["query"].dataType), T.StructField("id", v.schema["id"].dataType), T.StructField("score", T.DoubleType())]
    v = v.repartition(4 * spark.sparkContext.defaultParallelism)  # a file or two of narrow rows are many scores
    every = None
    for block in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast(_by_width(part.where("_q is not null").toArrow()))
        local = v.mapInArrow(_scorer(held, k), T.StructType(fields))
        every = local if every is None else every.unionByName(local)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _by_width(table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(keys, matrix) of a table of keys and vectors by the vectors' length; nulls within a vector become NaN."""
    import pyarrow.compute as pc

    widths, out = pc.list_value_length(table.column(1)).to_numpy(), {}
    for width in np.unique(widths):
        rows = table.filter(pc.equal(pc.list_value_length(table.column(1)), int(width)))
        flat = np.concatenate([np.asarray(c.flatten().to_numpy(zero_copy_only=False), dtype=np.float64) for c in _chunks(rows.column(1))]) if rows.num_rows else np.zeros(0)
        out[int(width)] = (rows.column(0).to_numpy(), flat.reshape(rows.num_rows, int(width)))
    return out


def _chunks(column) -> list:
    return column.chunks if hasattr(column, "chunks") else [column]


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products over the last axis, added from the first to the last as ``dot`` does."""
    total = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for i in range(a.shape[-1]):
        total += a[..., i] * b[..., i]
    return total


def _scorer(held, k: int):
    """Rows (query, id, score) of the k best vectors of a task for each query of a broadcast block."""

    def run(batches):
        import pyarrow as pa

        best: dict[int, list[np.ndarray]] = {}  # by width: positions of queries, ids and scores of the best so far
        lengths = {w: np.sqrt(_folded(m, m)) for w, (_, m) in held.value.items()}
        for batch in batches:
            for width, (ids, matrix) in _by_width(pa.Table.from_batches([batch])).items():
                if width not in held.value:
                    continue
                keys, asked = held.value[width]
                if width not in best:
                    best[width] = [np.zeros(0, np.int64), ids[:0], np.zeros(0)]
                length = np.sqrt(_folded(matrix, matrix))
                step = max(1, MAX_SCORES // max(len(keys), 1))
                for at in range(0, len(ids), step):
                    best[width] = _better(best[width], k, keys, asked, lengths[width], ids[at : at + step], matrix[at : at + step], length[at : at + step])
        for width, (at, ids, scores) in best.items():
            keys = held.value[width][0]
            for i in range(0, len(at), 65_536):
                columns = [keys[at[i : i + 65_536]], ids[i : i + 65_536], scores[i : i + 65_536]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "id", "score"])

    return run


def _better(best, k, keys, asked, asked_length, ids, matrix, length):
    """The best so far and a slice of vectors, down to the k best of each query."""
    at, known, scores = best
    scale = asked_length[:, None] * length[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        rough = np.where(scale > 0, asked @ matrix.T / scale, 0.0)
    rough[keys[:, None] == ids[None, :]] = -np.inf
    floor = np.full(len(keys), -np.inf)
    full = np.bincount(at, minlength=len(keys)) >= k
    lowest = np.full(len(keys), np.inf)
    np.minimum.at(lowest, at, scores)
    floor[full] = lowest[full]
    if rough.shape[1] > k:
        floor = np.maximum(floor, np.partition(np.nan_to_num(rough, nan=np.inf), -k, axis=1)[:, -k])
    # rounding moves a cosine by some 1e-14; NaN, which Spark's order puts first, is always scored
    row, column = np.nonzero(((rough >= floor[:, None] - 1e-9) & (rough > -np.inf)) | np.isnan(rough))
    if not len(row):
        return best
    across = asked_length[row] * length[column]
    with np.errstate(divide="ignore", invalid="ignore"):
        exact = np.where(across > 0, _folded(asked[row], matrix[column]) / across, 0.0)
    at, known, scores = np.concatenate([at, row]), np.concatenate([known, ids[column]]), np.concatenate([scores, exact])
    order = np.lexsort((known, np.where(np.isnan(scores), -np.inf, -scores), at))
    at, known, scores = at[order], known[order], scores[order]
    kept = np.arange(len(at)) - np.searchsorted(at, at) < k
    return [at[kept], known[kept], scores[kept]]


def graph_scores(candidates: DataFrame, scores: DataFrame, key: str = "id") -> DataFrame:
    """Add ``graph_score``: a candidate's node score over the greatest of the candidate set; 0 where it has no node."""
    joined = candidates.join(scores.select(key, F.col("score").alias("_g")), key, "left").withColumn("_g", F.coalesce("_g", F.lit(0.0)))
    top = F.max("_g").over(Window.partitionBy("query"))
    return joined.withColumn("graph_score", F.when(top > 0, F.col("_g") / top).otherwise(0.0)).drop("_g")


def alpha_fusion(candidates: DataFrame, alpha: float, min_vector: float = 0.0, min_graph: float = 0.0) -> DataFrame:
    """Add ``final``: alpha * vector + (1 - alpha) * graph, of rows that reach both thresholds.

    A row in a community gains a fifth, and keeps it only in the community of the leading row.
    """
    a = min(max(alpha, 0.0), 1.0)
    kept = candidates.where((F.col("vector_score") >= min_vector) & (F.col("graph_score") >= min_graph))
    base = kept.withColumn("final", (a * F.col("vector_score") + (1 - a) * F.col("graph_score")) * F.when(F.col("community") >= 0, 1.2).otherwise(1.0))
    leader = F.first("community").over(Window.partitionBy("query").orderBy(F.desc("final"), "id"))
    return base.withColumn("final", F.when((F.col("community") >= 0) & (leader >= 0) & (F.col("community") != leader), F.col("final") / 1.2).otherwise(F.col("final")))


def rank_fusion(candidates: DataFrame, k: int = 60, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Add ``final``: the sum of weight / (k + rank) over the vector and graph rankings of each query."""
    ranks = [F.row_number().over(Window.partitionBy("query").orderBy(F.desc(c), "id")) for c in ("vector_score", "graph_score")]
    return candidates.withColumn("final", weights[0] / (k + ranks[0]) + weights[1] / (k + ranks[1]))


def min_max(df: DataFrame, score: str, partition: str = "query") -> DataFrame:
    """Scores scaled to [0, 1] within each query; 1 where all are equal."""
    w = Window.partitionBy(partition)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(score, F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0))


def weighted_fusion(candidates: DataFrame, vector_weight: float, graph_weight: float) -> DataFrame:
    """Add ``final``: the weighted mean of both scores after min-max scaling within each query."""
    scaled = min_max(min_max(candidates, "vector_score"), "graph_score")
    return scaled.withColumn("final", (vector_weight * F.col("vector_score") + graph_weight * F.col("graph_score")) / (vector_weight + graph_weight))


def diverse_top_k(results: DataFrame, k: int, per_community: int) -> DataFrame:
    """The k best of each query with at most so many of one community; unknown communities (-1) are unlimited."""
    order = [F.desc("final"), F.col("id")]
    place = F.row_number().over(Window.partitionBy("query", "community").orderBy(*order))
    kept = results.withColumn("_p", place).where((F.col("community") < 0) | (F.col("_p") <= per_community)).drop("_p")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def expand(results: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(query, id, final): up to ``limit`` unseen neighbours of each query's results, in rank order, at 0.7 of the score."""
    near = results.select("query", F.col("id").alias("src"), "rank", "final").join(edges.select("src", F.col("dst").alias("id")), "src")
    near = near.join(results.select("query", "id"), ["query", "id"], "left_anti")
    best = near.groupBy("query", "id").agg(F.min(F.struct("rank", (F.col("final") * 0.7).alias("final"))).alias("b")).select("query", "id", "b.rank", "b.final")
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank", "id"))
    return best.withColumn("place", place).where(F.col("place") <= limit).select("query", "id", "final", "place")


def link_scores(pairs: DataFrame, vectors: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """(src, dst, score): the logistic of the dot product of two nodes' vectors."""
    a, b = vectors.select(F.col(key).alias("src"), F.col(vector).alias("_a")), vectors.select(F.col(key).alias("dst"), F.col(vector).alias("_b"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", (1 / (1 + F.exp(-dot(F.col("_a"), F.col("_b"))))).alias("score"))


def attention(edges: DataFrame, vectors: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """(src, dst, weight): positive cosine of each edge's ends over the sum of the source's; even where all are 0."""
    a, b = vectors.select(F.col(key).alias("src"), F.col(vector).alias("_a")), vectors.select(F.col(key).alias("dst"), F.col(vector).alias("_b"))
    raw = edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", F.greatest(cosine(F.col("_a"), F.col("_b")), F.lit(0.0)).alias("raw"))
    w = Window.partitionBy("src")
    total = F.sum("raw").over(w)
    return raw.select("src", "dst", F.when(total > 0, F.col("raw") / total).otherwise(1 / F.count(F.lit(1)).over(w)).alias("weight"))


def attention_heads(edges: DataFrame, vectors: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """(src, dst, head1..head4, mean): positive cosine of the ends times a head's factor."""
    a, b = vectors.select(F.col(key).alias("src"), F.col(vector).alias("_a")), vectors.select(F.col(key).alias("dst"), F.col(vector).alias("_b"))
    raw = edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", F.greatest(cosine(F.col("_a"), F.col("_b")), F.lit(0.0)).alias("raw"))
    factors = (1.0, 0.9, 1.1, 0.95)  # fixed values: what each head multiplies by
    heads = [(F.col("raw") * f).alias(f"head{i + 1}") for i, f in enumerate(factors)]
    return raw.select("src", "dst", *heads, (F.col("raw") * sum(factors) / len(factors)).alias("mean"))


def score_classes(scores: DataFrame, n_classes: int) -> DataFrame:
    """(id, class, confidence): the min-max scaled score cut into classes."""
    span = scores.agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    scaled = F.when(F.col("_high") > F.col("_low"), (F.col("score") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    joined = scores.join(F.broadcast(span)).select("id", scaled.alias("confidence"))
    return joined.select("id", F.floor(F.col("confidence") * (n_classes - 1)).cast("long").alias("class"), "confidence")


def softmax_classes(df: DataFrame, logits: str, key: str = "id") -> DataFrame:
    """(id, class, confidence): arg max and its softmax probability of an array of logits; ties to the least class."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return df.select(F.col(key).alias("id"), (F.array_position(logits, top) - 1).cast("long").alias("class"), (1 / total).alias("confidence"))


def attention_fallback(edges: DataFrame, vectors: DataFrame, ranks: DataFrame, n_classes: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """(id, class, score) without a model: half a node's features and half its neighbours' by attention.

    The class is |sum of the mixed features| * 1000 in whole numbers, modulo the classes; the score adds 0.3 of a
    hundred times the node's rank to 0.7 of that sum.
    """
    sums = vectors.select(F.col(key).alias("id"), F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double")).alias("own"))
    weights = attention(edges, vectors, key, vector)
    near = weights.join(sums.select(F.col("id").alias("dst"), F.col("own").alias("_x")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("weight") * F.col("_x")).alias("near"))
    mixed = sums.join(near, "id", "left").join(ranks.select("id", F.col("score").alias("_rank")), "id", "left")
    total = 0.5 * F.col("own") + 0.5 * F.coalesce("near", F.lit(0.0))
    score = 0.7 * total + 0.3 * 100 * F.coalesce("_rank", F.lit(0.0))
    return mixed.select("id", (F.floor(F.abs(total) * 1000) % n_classes).cast("long").alias("class"), score.alias("score"))
