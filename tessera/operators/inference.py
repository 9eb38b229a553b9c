"""Node classification and link prediction with a model of the caller's: scores, classes and links are DataFrame expressions.

A model is a function ``(features, src, dst) -> logits`` over numpy arrays, src and dst as row numbers of
features.  :func:`onnx_model` makes one of a model file where the runtime is installed.  A graph within the
one-task bound goes through the model whole; beyond it, ``classify_by_part`` runs it over the closed
neighbourhood of each part, which is exact for a model that looks as many hops far as the parts are widened.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import ONE_TASK_EDGES, fits_one_task

Model = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def onnx_model(content: bytes, features: str = "features", edges: str = "edge_index", output: str | None = None) -> Model:
    """A model of the bytes of a model file; a session is made once in each worker."""
    held: dict[str, object] = {}

    def run(x: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        if "session" not in held:
            import onnxruntime  # an optional runtime: its absence is the caller's error

            held["session"] = onnxruntime.InferenceSession(content, providers=["CPUExecutionProvider"])
        session = held["session"]
        given = {features: x.astype(np.float32), edges: np.stack([src, dst]).astype(np.int64)}
        names = {i.name for i in session.get_inputs()}
        return session.run([output] if output else None, {k: v for k, v in given.items() if k in names})[0]

    return run


def convolution(weights: list[np.ndarray]) -> Model:
    """A graph convolution of numpy weights: symmetric normalisation with self-loops, rectified but for the last layer."""

    def run(x: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        n = len(x)
        every = np.arange(n)
        a, b = np.concatenate([src, every]), np.concatenate([dst, every])
        degree = np.bincount(b, minlength=n)
        share = 1 / np.sqrt(degree[a] * degree[b])
        for k, w in enumerate(weights):
            sent = (x @ w)[a] * share[:, None]
            x = np.zeros((n, w.shape[1]))
            np.add.at(x, b, sent)
            if k < len(weights) - 1:
                x = np.maximum(x, 0)
        return x

    return run


def attention(weights: list[np.ndarray], vectors: list[np.ndarray], slope: float = 0.2) -> Model:
    """A graph attention network of one head a layer in numpy: scores of both ends, softmax over in-edges and the node itself."""

    def run(x: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        n = len(x)
        every = np.arange(n)
        a, b = np.concatenate([src, every]), np.concatenate([dst, every])
        for k, (w, v) in enumerate(zip(weights, vectors, strict=True)):
            h = x @ w
            half = len(v) // 2
            e = (h @ v[:half])[a] + (h @ v[half:])[b]
            e = np.where(e > 0, e, slope * e)
            top = np.full(n, -np.inf)
            np.maximum.at(top, b, e)
            e = np.exp(e - top[b])
            total = np.bincount(b, e, minlength=n)
            x = np.zeros_like(h)
            np.add.at(x, b, h[a] * (e / total[b])[:, None])
            if k < len(weights) - 1:
                x = np.maximum(x, 0)
        return x

    return run


def _run_model(model: Model, ids: np.ndarray, features: np.ndarray, src, dst) -> pd.DataFrame:
    inside = np.isin(src, ids) & np.isin(dst, ids)
    logits = model(features, np.searchsorted(ids, src[inside]), np.searchsorted(ids, dst[inside])) if len(ids) else np.zeros((0, 1))
    return pd.DataFrame({"id": ids, "logits": [row.astype(float) for row in np.asarray(logits)]})


def node_logits(features: DataFrame, edges: DataFrame, model: Model) -> DataFrame:
    """(id, logits) of every node of ``features`` (id, values), by a model over the whole graph in one task.

    Raises beyond the bound of one task: use :func:`node_logits_by_part` there.
    """
    if not fits_one_task(features, edges):
        raise ValueError(f"one task takes at most {ONE_TASK_EDGES} edges and nodes; use node_logits_by_part")
    one = F.lit(0).alias("part")
    return _logits(features.select(one, "id", "values", F.lit(True).alias("own")), edges.select(one, "src", "dst"), model)


def node_logits_by_part(features: DataFrame, edges: DataFrame, model: Model, parts: int, hops: int = 2) -> DataFrame:
    """(id, logits): the nodes are dealt to ``parts``, and each part runs with all that leads to it within ``hops``.

    That is exact for a model of as many layers.  A hub's in-neighbourhood meets in the parts that need it.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    own = features.select(part.alias("part"), "id")
    wide = own
    for _ in range(hops):
        back = wide.join(edges.select(F.col("dst").alias("id"), "src"), "id").select("part", F.col("src").alias("id"))
        wide = wide.unionByName(back).distinct()
    mine = wide.join(own.withColumn("own", F.lit(True)), ["part", "id"], "left").join(features, "id")
    near = edges.join(wide.select("part", F.col("id").alias("dst")), "dst").select("part", "src", "dst")
    return _logits(mine.select("part", "id", "values", F.coalesce("own", F.lit(False)).alias("own")), near, model)


def _logits(nodes: DataFrame, edges: DataFrame, model: Model) -> DataFrame:
    def run(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("id")
        ids = left["id"].to_numpy(dtype=np.int64)
        values = np.stack(left["values"].to_list()) if len(left) else np.zeros((0, 1))
        right = right.sort_values(["src", "dst"])
        out = _run_model(model, ids, values, right["src"].to_numpy(dtype=np.int64), right["dst"].to_numpy(dtype=np.int64))
        return out[left["own"].to_numpy(dtype=bool)]

    nodes, edges = nodes.toDF("part", "id", "values", "own"), edges.toDF("part", "src", "dst")  # one lineage, told apart
    return nodes.groupBy("part").cogroup(edges.groupBy("part")).applyInPandas(run, "id long, logits array<double>")


def probabilities(logits: str | Column) -> Column:
    """Softmax of an array."""
    x = F.col(logits) if isinstance(logits, str) else logits
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)


def classified(logits: DataFrame) -> DataFrame:
    """(id, class, confidence, probabilities): the likeliest class, the first of several."""
    p = logits.select("id", probabilities("logits").alias("probabilities"))
    best = F.array_max("probabilities")
    return p.select("id", (F.array_position("probabilities", best) - 1).alias("class"), best.alias("confidence"), "probabilities")


def predicted_links(embeddings: DataFrame, pairs: DataFrame, vector: str = "probabilities") -> DataFrame:
    """(src, dst, score): the logistic function of the inner product of both ends' vectors, which are the class probabilities."""
    a = embeddings.select(F.col("id").alias("src"), F.col(vector).alias("_a"))
    b = embeddings.select(F.col("id").alias("dst"), F.col(vector).alias("_b"))
    dot = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", (1 / (1 + F.exp(-dot))).alias("score"))
