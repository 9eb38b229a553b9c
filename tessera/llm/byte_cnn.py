"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become a fixed embedding (their kind, and a few random dimensions).  Learned filters of
``WIDTH`` bytes slide over the whole document in steps of ``STEP``; their responses are max-pooled
over overlapping chunks, and the mean and the maximum over all chunks go through one hidden layer to
one probability.  Every byte of a document lies in a chunk, whatever its length.

Training takes a bounded sample: at most ``MAX_PER_CLASS`` labelled documents of each class, those
with the least hashes, and of them as many as ``MAX_TRAINING_BYTES`` hold in all.  Scoring covers every
document, slice by slice of a batch, on the executors; filters answer a bounded stretch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, ship, text_of, text_slices, tidy

#: Bound on the labelled rows of each class that the network is fitted on, and on the bytes of all of them.
MAX_PER_CLASS = 1500
MAX_TRAINING_BYTES = 1 << 26
#: Filter width and step in bytes, filters, and units of the hidden layer.
WIDTH, STEP, FILTERS, HIDDEN = 8, 4, 24, 16
#: Filter places in a block; a chunk is CHUNK blocks and shares one block with the next.
BLOCK, CHUNK = 32, 4
KINDS, RANDOM = 7, 5
STEPS, BATCH, RATE = 700, 32, 0.01
#: Blocks that are scored at a time.
STRETCH = 512


def _embedding() -> np.ndarray:
    """256 rows: what kind a byte is, and some random dimensions."""
    b = np.arange(256)
    upper, lower, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    space, line, high = b == 32, b == 10, b >= 128
    sign = ~(upper | lower | digit | space | line | high) & (b > 0)
    kinds = np.stack([upper, lower, digit, space, line, high, sign], axis=1).astype(np.float32)
    random = np.random.default_rng(5).normal(0, 0.6, (256, RANDOM)).astype(np.float32)
    random[0] = 0
    return np.concatenate([kinds, random], axis=1)


_TABLE = _embedding()
_SIZE = WIDTH * (KINDS + RANDOM)


class Layout:
    """Documents laid out one after another, each padded so that no filter sees two of them."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        places = np.maximum(1, -(-sizes // STEP))
        blocks = -(-places // BLOCK)
        room = blocks * BLOCK * STEP
        starts = np.cumsum(room) - room
        flat = np.zeros(int(room.sum()) + WIDTH, dtype=np.uint8)
        for text, at in zip(texts, starts.tolist(), strict=True):
            flat[at : at + len(text)] = np.frombuffer(text, dtype=np.uint8)
        # the first WIDTH - STEP bytes after a document belong to the next one: blank them for its last place
        self.flat, self.blocks, self.sizes = flat, blocks, sizes
        self.last_place = (starts + room) // STEP - 1
        chunks = np.maximum(1, -(-(blocks - 1) // (CHUNK - 1)))
        self.chunks = chunks
        first_block = np.cumsum(blocks) - blocks
        doc = np.repeat(np.arange(len(texts)), chunks)
        within = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        at = first_block[doc] + within * (CHUNK - 1)
        self.chunk_blocks = np.minimum(at[:, None] + np.arange(CHUNK), (first_block + blocks - 1)[doc][:, None])
        self.chunk_starts = np.cumsum(chunks) - chunks

    def columns(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """One row for each filter place in [first, last): the embedded bytes that the filters see there."""
        last = (len(self.flat) - WIDTH) // STEP if last is None else last
        embedded = _TABLE[self.flat[first * STEP : last * STEP + WIDTH - STEP]]
        width = KINDS + RANDOM
        shape, strides = (last - first, _SIZE), (STEP * width * 4, 4)
        seen = np.lib.stride_tricks.as_strided(embedded, shape, strides)
        rows = np.ascontiguousarray(seen)
        ends = self.last_place[np.searchsorted(self.last_place, first) : np.searchsorted(self.last_place, last)]
        rows[ends - first, STEP * width :] = 0
        return rows

    def extras(self) -> np.ndarray:
        return np.stack([np.log1p(self.sizes) / 10, np.minimum(self.sizes, 500) / 500], axis=1).astype(np.float32)


def new_weights(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def draw(*shape):
        return rng.normal(0, np.sqrt(2 / shape[0]), shape).astype(np.float32)

    return {
        "filters": draw(_SIZE, FILTERS),
        "filter_bias": np.zeros(FILTERS, np.float32),
        "hidden": draw(2 * FILTERS + 2, HIDDEN),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": draw(HIDDEN, 1),
        "out_bias": np.zeros(1, np.float32),
    }


def forward(weights: dict[str, np.ndarray], layout: Layout, columns: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Probabilities, and what the backward pass needs."""
    response = columns @ weights["filters"]
    scores, state = _from_blocks(weights, layout, response.reshape(-1, BLOCK, FILTERS).max(axis=1))
    return scores, (response, *state)


def _from_blocks(weights, layout: Layout, blocks: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Probabilities from the filters' largest response in each block."""
    held = blocks[layout.chunk_blocks]
    pooled = np.maximum(held.max(axis=1) + weights["filter_bias"], 0)
    mean = np.add.reduceat(pooled, layout.chunk_starts) / layout.chunks[:, None]
    most = np.maximum.reduceat(pooled, layout.chunk_starts)
    joined = np.concatenate([mean, most, layout.extras()], axis=1)
    hidden = np.maximum(joined @ weights["hidden"] + weights["hidden_bias"], 0)
    logit = (hidden @ weights["out"] + weights["out_bias"])[:, 0]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), (held, pooled, most, joined, hidden)


def backward(weights, layout: Layout, columns, state, error: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients; ``error`` is the derivative of the loss by each logit."""
    response, held, pooled, most, joined, hidden = state
    grad = {"out": hidden.T @ error[:, None], "out_bias": error.sum(keepdims=True)}
    to_hidden = (error[:, None] @ weights["out"].T) * (hidden > 0)
    grad["hidden"], grad["hidden_bias"] = joined.T @ to_hidden, to_hidden.sum(axis=0)
    to_joined = to_hidden @ weights["hidden"].T
    doc = np.repeat(np.arange(len(layout.chunks)), layout.chunks)
    to_pooled = to_joined[doc, :FILTERS] / layout.chunks[doc][:, None]
    top = pooled == most[doc]  # chunks share blocks, and so may share the maximum
    shares = np.add.reduceat(top.astype(np.float32), layout.chunk_starts)
    to_pooled = to_pooled + to_joined[doc, FILTERS : 2 * FILTERS] * top / shares[doc]
    to_pooled = to_pooled * (pooled > 0)
    grad["filter_bias"] = to_pooled.sum(axis=0)
    chunk, which = np.nonzero(to_pooled)
    block = layout.chunk_blocks[chunk, held[chunk, :, which].argmax(axis=1)]
    places = response.reshape(-1, BLOCK, FILTERS)[block, :, which].argmax(axis=1) + block * BLOCK
    sparse = np.zeros((len(response), FILTERS), dtype=np.float32)
    np.add.at(sparse, (places, which), to_pooled[chunk, which])
    touched = np.flatnonzero(sparse.any(axis=1))
    grad["filters"] = columns[touched].T @ sparse[touched]
    return grad


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights fitted by Adam on balanced batches; one class alone gives weights that score near it."""
    weights = new_weights()
    labels = np.asarray(labels, dtype=np.float32)
    if not len(texts):
        return weights
    if labels.min() == labels.max():
        weights["out"][:] = 0
        weights["out_bias"][:] = 4 if labels[0] else -4
        return weights
    rng = np.random.default_rng(seed)
    sides = [np.flatnonzero(labels == k) for k in (0, 1)]
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    for step in range(1, steps + 1):
        picked = np.concatenate([rng.choice(side, BATCH // 2) for side in sides])
        layout = Layout([texts[i] for i in picked])
        columns = layout.columns()
        scores, state = forward(weights, layout, columns)
        error = ((scores - labels[picked]) / len(picked)).astype(np.float32)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in backward(weights, layout, columns, state, error).items():
            g = g.reshape(weights[k].shape) + 1e-5 * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return {k: v.astype(np.float32) for k, v in weights.items()}


def score_texts(weights: dict[str, np.ndarray], texts: list[bytes], budget: int = 400_000) -> np.ndarray:
    """Probabilities of whole texts, laid out in parts of about ``budget`` bytes."""
    out, part, size = [], [], 0
    for text in texts:
        part.append(text)
        size += len(text) + BLOCK * STEP
        if size >= budget:
            out.append(_score(weights, part))
            part, size = [], 0
    if part:
        out.append(_score(weights, part))
    return np.concatenate(out) if out else np.zeros(0)


def _score(weights, texts: list[bytes]) -> np.ndarray:
    layout = Layout(texts)
    blocks = np.empty((int(layout.blocks.sum()), FILTERS), dtype=np.float32)
    for at in range(0, len(blocks), STRETCH):
        rows = layout.columns(at * BLOCK, min(at + STRETCH, len(blocks)) * BLOCK)
        blocks[at : at + STRETCH] = (rows @ weights["filters"]).reshape(-1, BLOCK, FILTERS).max(axis=1)
    return _from_blocks(weights, layout, blocks)[0].astype(np.float64)


def held_out_remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5: remainder 0 is never trained on."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def training_sample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality"):
    """Texts and labels of the bounded sample, on the driver: ``MAX_PER_CLASS`` rows of each class and ``MAX_TRAINING_BYTES`` at most.

    Labels come from rows outside the held-out fold; a null label, or two labels for one id that differ, are left out.
    Texts of any length are taken whole, in the order of the ids' hashes, as long as all together keep to the bound.
    """
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & (held_out_remainder(doc_id) != 0))
    agreed = usable.groupBy(F.col(doc_id).alias("label_id")).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    picked = [agreed.where(F.col("y") == k).orderBy(F.xxhash64("label_id"), "label_id").limit(MAX_PER_CLASS) for k in (0, 1)]
    ids = picked[0].unionByName(picked[1]).select("label_id", "y")
    given = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("body"))
    met = given.join(F.broadcast(ids), F.col("id") == F.col("label_id"))
    sizes = met.groupBy("id").agg(F.max(F.octet_length("body")).alias("size"), F.xxhash64("id").alias("h"))
    chosen, held = [], 0
    for row in sorted(sizes.collect(), key=lambda r: (r["h"], r["id"])):
        if held + row["size"] <= MAX_TRAINING_BYTES:
            chosen.append(row["id"])
            held += row["size"]
    wanted = docs.sparkSession.createDataFrame([(x,) for x in chosen], docs.select(F.col(doc_id).alias("id")).schema)
    rows = met.join(F.broadcast(wanted), "id").groupBy("id").agg(F.min("body").alias("body"), F.first("y").alias("y")).collect()
    rows.sort(key=lambda r: r["id"])
    return [r["body"].encode() for r in rows], np.array([r["y"] for r in rows], dtype=np.float32)


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id", label: str = "quality"
) -> DataFrame:
    """Every row of ``docs`` with ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    Only the text makes the score; a null or empty text is scored as one without bytes, a text of any
    length by all its bytes.  ``held_out`` is false for a null doc_id, which no label can name.  Repeated
    rows get equal scores.  Columns of ``docs`` named like the results are replaced.  Without labels the
    untrained network scores.  An empty table stays empty.
    """
    docs = fresh(docs, "held_out", "score", "predicted")
    ship(docs.sparkSession)
    weights = train(*training_sample(docs, labels, text, doc_id, label))
    names = docs.columns
    at = names.index(text)

    @tidy
    def score(batches):
        for batch in batches:
            for part, texts in text_slices(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score_texts(weights, texts))], names=[*part.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    scored = docs.mapInArrow(score, f"{fields}, score double")
    return scored.withColumn("held_out", F.coalesce(held_out_remainder(doc_id) == 0, F.lit(False))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
