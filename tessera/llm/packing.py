"""Packing by concatenate and cut.

Pass one tokenizes every document once and writes the ids with their place in the task's own
concatenation.  The tasks' totals, summed in order, give each task its place in the global
concatenation.  Pass two cuts that line at every ``length`` ids: a sequence that spans documents,
or tasks, is made of the boundary records that name it.
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

_IDS = "part int, at long, n_tokens long, ids binary"


def token_table(docs: DataFrame, path: str, keeps_spaces: bool, end_id: int, text: str = "text", name: str = "tokens") -> DataFrame:
    """``docs`` without its text, with the ids of each text and ``end_id``, written in the shared folder.

    Adds ``part`` and ``at`` (the task, and the ids before the document in that task), ``n_tokens`` and
    ``ids`` (little-endian uint16).  Null text counts as empty and has the end id alone.
    """
    docs = fresh(docs, "part", "at", "n_tokens", "ids")
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    end = np.array([end_id], dtype="<u2").tobytes()

    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        tokens = encoder(path, keeps_spaces)
        for batch in batches:
            for rows, texts in text_slices(batch, len(others), 500_000):
                ids = [x + end for x in tokens.encode([t.decode() for t in texts])]
                counts = np.array([len(x) // 2 for x in ids], dtype=np.int64)
                before = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                columns = [rows.column(i) for i in range(len(others))]
                columns += [pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(before), pa.array(counts), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, "part", "at", "n_tokens", "ids"])

    kept = docs.select(*[F.col(f"`{c}`") for c in others], text_of(text).alias(text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return write_table(kept.mapInArrow(tidy(encode, keeps_tokens=True), f"{fields}, {_IDS}" if fields else _IDS), name)


def with_starts(tokens: DataFrame, name: str = "start") -> DataFrame:
    """Add the number of ids before each document in the concatenation of all tasks, in order.

    One row for each task meets in one place, and as many are broadcast.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select("part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return tokens.join(F.broadcast(places), "part").withColumn(name, F.col("_before") + F.col("at")).drop("_before")


def cut_pieces(tokens: DataFrame, length: int) -> DataFrame:
    """The pieces of documents with a global ``start``: one row for each document and sequence.

    Adds ``piece_start`` (ids of the document before the piece), ``length``, ``piece_ids`` (little-endian
    uint16), ``sequence_id`` and ``offset`` (ids of the sequence before the piece).  A document of
    any length is cut into as many rows; no row holds more than ``length`` ids.
    """
    first = F.floor(F.col("start") / length)
    last = F.floor((F.col("start") + F.col("n_tokens") - 1) / length)
    cut = tokens.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("sequence_id") * length, F.col("start"))
    stop = F.least((F.col("sequence_id") + 1) * length, F.col("start") + F.col("n_tokens"))
    cut = cut.withColumn("piece_start", begin - F.col("start")).withColumn("length", stop - begin)
    cut = cut.withColumn("offset", begin - F.col("sequence_id") * length)
    piece = F.expr("substring(ids, cast(2 * piece_start + 1 as int), cast(2 * length as int))")
    return cut.withColumn("piece_ids", piece)


def packed_pieces(
    docs: DataFrame, length: int = 1024, path: str | None = None, keeps_spaces: bool = True, end_id: int = 0, text: str = "text"
) -> DataFrame:
    """All documents packed into sequences of ``length`` ids; only the last one can be short.

    One row for each piece with the columns of ``docs`` but the text (columns named like the results are
    replaced): ``piece_start``, ``length``, ``ids_crc32`` (of little-endian uint32 ids), ``doc_tokens``,
    ``sequence_id``, ``offset`` and ``piece_ids``.  The order of documents is that of the input's
    partitions.  Null and empty texts give one piece with the end id; repeated rows are packed each
    time; an empty table gives an empty table.
    """
    docs = fresh(docs, "piece_start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "piece_ids", "start")
    others = [f"`{c}`" for c in docs.columns if c != text]
    tokens = token_table(docs, path or default_path("byte_bpe_50k.json"), keeps_spaces, end_id, text, "packing")
    pieces = cut_pieces(with_starts(tokens), length)
    names = [c.strip("`") for c in others]

    def summed(batches):
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), dtype="<u2").astype("<u4")) for x in batch.column(len(names))]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(crc, pa.int64())], names=[*batch.schema.names, "ids_crc32"])

    results = pieces.select(*others, "piece_ids", "piece_start", "length", F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in results.schema.fields)
    return results.mapInArrow(summed, f"{fields}, ids_crc32 long")
