"""Token-id files in Simple-8b word-aligned coding.

A file row is one block of whole documents, ``BLOCK`` ids or a little more: a sequence of 64-bit little-endian words, each with a
selector in its top four bits and 60 bits of ids, all of one width, lowest bits first.  Selectors 1
to 14 stand for 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 and 1 ids of 1, 2, 3, 4, 5, 6, 7, 8, 10, 12,
15, 20, 30 and 60 bits; selector 0 is an escape: the next word is one id of 64 bits.  A block's row
carries its documents' ids and offsets, so blocks decode independently and in numpy.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, ship, text_of, text_slices, tidy, write_table
from tessera.llm.tokens import default_path, encoder

#: A block is full when it holds so many ids; documents are never split.
BLOCK = 1 << 16
# Ids a word holds by selector 1 to 14, and their widths in bits.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)


def _all_of_next(ok: np.ndarray, count: int) -> np.ndarray:
    """For each position with ``count`` positions from there on, whether all of them are ok."""
    have, run = 1, ok
    while have < count:
        step = min(have, count - have)
        run = run[: len(run) - step] & run[step:]
        have += step
    return run


def _fits(ids: np.ndarray) -> np.ndarray:
    """For each position, the smallest selector whose ids from there on all fit; 0 is the escape."""
    n = len(ids)
    best = np.zeros(n, dtype=np.uint8)
    for selector in range(14, 0, -1):
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        if count > n:
            break
        fit = _all_of_next(ids < (1 << width), count)
        if not fit.any():  # smaller selectors ask for more ids of fewer bits
            break
        best[: n - count + 1][fit] = selector
    return best


def encode_block(ids: np.ndarray) -> bytes:
    """The words of a block of ids, any values below 2**64."""
    narrow = np.ascontiguousarray(ids)
    selectors = _fits(narrow)
    ids = narrow.astype(np.uint64)
    steps = COUNTS[selectors].tolist()
    at, starts = 0, []
    while at < len(ids):
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, dtype=np.int64)
    chosen = selectors[starts]
    word_at = np.arange(len(starts)) + np.cumsum(chosen == 0) - (chosen == 0)
    words = np.zeros(len(starts) + int((chosen == 0).sum()), dtype="<u8")
    for selector in np.unique(chosen):
        mine = chosen == selector
        if selector == 0:
            words[word_at[mine] + 1] = ids[starts[mine]]
            continue
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        packed = np.full(int(mine.sum()), np.uint64(selector) << np.uint64(60), dtype=np.uint64)
        for k in range(count):
            packed |= ids[starts[mine] + k] << np.uint64(k * width)
        words[word_at[mine]] = packed
    return words.tobytes()


def decode_block(payload: bytes) -> np.ndarray:
    """The ids of a block."""
    words = np.frombuffer(payload, dtype="<u8")
    selectors = (words >> np.uint64(60)).astype(np.int64)
    if not selectors.all() and len(words):  # what follows an escape is no word of ids, whatever its top bits
        plain, at, raw = selectors.tolist(), 0, np.zeros(len(words), dtype=bool)
        while at < len(plain):
            if plain[at] == 0 and at + 1 < len(plain):
                raw[at + 1] = True
                at += 1
            at += 1
        escaped = np.flatnonzero(raw)
        selectors = np.where(raw, -1, selectors)
    else:
        escaped = np.zeros(0, dtype=np.int64)
    sizes = np.where(selectors < 0, 0, COUNTS[selectors])
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for selector in np.unique(selectors[selectors > 0]):
        mine = np.flatnonzero(selectors == selector)
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        mask = np.uint64((1 << width) - 1)
        for k in range(count):
            out[ends[mine] - count + k] = (words[mine] >> np.uint64(k * width)) & mask
    out[ends[escaped - 1] - 1] = words[escaped]
    return out


def write_token_files(
    docs: DataFrame, path: str | None = None, keeps_spaces: bool = False, end_id: int = 1, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order and return the files' table.

    Rows: ``part`` and ``block`` (their order is the order of ids), ``n_ids``, ``doc_ids`` and ``doc_ends`` (for
    each document that ends in the block, the ids of the block up to its end), ``n_docs`` and ``payload``.
    Rows with a null doc_id come first; rows that agree in doc_id are ordered by text.  A null text
    counts as empty; a text of any length is encoded whole and lies in one block.  Repeated rows are written each
    time.  No other column of ``docs`` is read, so none can clash.  doc_id is cast to long.  An empty table gives no rows.
    """
    ship(docs.sparkSession)
    vocabulary = path or default_path("word_bpe_49k.json")
    end = np.array([end_id], dtype="<u2").tobytes()

    def encode(batches):
        part, block = TaskContext.get().partitionId(), 0
        tokens = encoder(vocabulary, keeps_spaces)
        names, pieces, size = [], [], 0

        def full_block():
            nonlocal names, pieces, size, block
            ends = np.cumsum([len(x) for x in pieces])
            values = ([part], [block], [size], [names], [ends], [len(names)], [encode_block(np.concatenate(pieces))])
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
            columns = ["part", "block", "n_ids", "doc_ids", "doc_ends", "n_docs", "payload"]
            block, names, pieces, size = block + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=columns)

        for batch in batches:
            for rows, texts in text_slices(batch, 1, 500_000):
                for name, ids in zip(rows.column(0).to_pylist(), tokens.encode([t.decode() for t in texts]), strict=True):
                    names.append(name)
                    pieces.append(np.frombuffer(ids + end, dtype="<u2"))
                    size += len(pieces[-1])
                    if size >= BLOCK:
                        yield full_block()
        if pieces:
            yield full_block()

    schema = "part int, block long, n_ids long, doc_ids array<long>, doc_ends array<long>, n_docs long, payload binary"
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
    ordered = ordered.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return write_table(ordered.mapInArrow(tidy(encode, keeps_tokens=True), schema), "simple8b")


def read_token_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents from the files: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32``, ``ids``.

    Blocks decode one by one; a prefix sum over their id counts places them.  ``ids`` are little-endian
    uint32 bytes, left out where ``with_ids`` is false.
    """
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("total"))
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("total").over(parts), F.lit(0)).alias("part_ids"))
    blocks = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = files.select("part", "block", F.coalesce(F.sum("n_ids").over(blocks), F.lit(0)).alias("block_ids"))
    places = index.join(F.broadcast(parts), "part").select("part", "block", (F.col("part_ids") + F.col("block_ids")).alias("first_id"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["payload"])
                if len(ids) != row["n_ids"]:
                    raise ValueError("a token block does not hold the ids that it names")
                ends = np.array(row["doc_ends"], dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                body = ids.astype("<u4").tobytes()
                pieces = [body[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["first_id"] + starts),
                    pa.array(ends - starts),
                    pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(pieces, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    placed = files.join(places, ["part", "block"]).select("doc_ids", "doc_ends", "n_ids", "payload", "first_id")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return placed.mapInArrow(decode, schema)
