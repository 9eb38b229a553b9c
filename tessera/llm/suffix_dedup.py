"""Removal of repeated byte strings by external suffix sorting.

Every byte that lies in a ``LENGTH``-byte string which also starts earlier is removed.  A string is
anchored at the leftmost least of its 51 50-byte hashes, so equal strings have equal anchors and meet
by a shuffle of anchors, whatever the documents.  Anchors met once pass straight out; around the
others, the bytes of the strings that they anchor are dealt to shards.  A shard is sorted by
external induced sorting with common prefixes: suffixes that share ``LENGTH`` bytes stand
together, and all but the first to start are repeats.

Documents of equal texts are one unit throughout: only the first of them is examined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, ship, text_of, text_slices, tidy, write_table
from tessera.llm.exact_dedup import filter_bits, slot_filter, with_membership
from tessera.llm.compact_windows import _sliding
from tessera.llm.induced_sort import suffix_order
from tessera.llm.shingles import mix
from tessera.llm.shingles import _powers

LENGTH, GRAM = 100, 50
_WINDOW = LENGTH - GRAM + 1
#: Bytes of distinct strings after which a shard is sorted; one anchor's strings are never parted.
SHARD_BYTES = 6_000_000
_LOW = np.uint64((1 << 28) - 1)
_EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(texts: list[bytes]):
    """(text, hash, place, first start, last start) of the anchors of all ``LENGTH``-byte strings of the texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    body = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(body)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashed = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    order = (hashed & ~_LOW) | np.arange(len(hashed), dtype=np.uint64)
    chosen = (_sliding(order, _WINDOW, np.minimum) & _LOW).astype(np.int64)  # the anchor of the string at each place
    stops = np.cumsum(sizes)
    left = np.repeat(stops, sizes)[: len(chosen)] - np.arange(len(chosen))
    whole = left >= LENGTH
    edge = np.ones(len(chosen), dtype=bool)
    edge[1:] = (chosen[1:] != chosen[:-1]) | (whole[1:] != whole[:-1])
    begin = np.flatnonzero(edge)
    last = np.append(begin[1:], len(chosen)) - 1
    real = whole[begin]
    begin, last = begin[real], last[real]
    place = chosen[begin]
    text = np.searchsorted(stops, begin, side="right")
    base = (stops - sizes)[text]
    return text, hashed[place].view(np.int64), place - base, begin - base, last - base


def _repeats(entries: list[tuple], folder: str | None = None):
    """Repeated strings among distinct byte pieces of a shard: (unit, start, stop) of bytes to remove.

    ``entries``: (piece, unit, order of the unit, start of the piece), the first occurrence of each piece.
    """
    pieces = [e[0] for e in entries]
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", dtype=np.uint8)
    order, shared = suffix_order(text, folder)
    group = np.cumsum(shared < LENGTH)
    piece = np.searchsorted(starts, order, side="right") - 1
    within = order - starts[piece]
    whole = within + LENGTH <= sizes[piece]
    group, piece, within = group[whole], piece[whole], within[whole]
    unit_rank = {u: r for r, u in enumerate(sorted({e[2] for e in entries}))}
    rank = np.array([unit_rank[e[2]] for e in entries], dtype=np.int64)[piece]
    at = np.array([e[3] for e in entries], dtype=np.int64)[piece] + within
    by = np.lexsort((at, rank, group))
    again = np.zeros(len(by), dtype=bool)
    again[1:] = group[by][1:] == group[by][:-1]
    piece, at = piece[by][again], at[by][again]
    by = np.lexsort((at, piece))
    piece, at = piece[by], at[by]
    if not len(piece):
        return
    split = np.ones(len(piece), dtype=bool)
    split[1:] = (piece[1:] != piece[:-1]) | (at[1:] > at[:-1] + LENGTH)
    first = np.flatnonzero(split)
    last = np.append(first[1:], len(piece)) - 1
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        yield entries[piece[a]][1], int(at[a]), int(at[b]) + LENGTH


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(unit, low, high): byte spans to remove from the text whose MD5 is ``unit``; ``docs`` has (id, unit, text)."""

    @tidy
    def find(batches):
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                text, key, place, _, _ = anchors(texts)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part.column(0).to_numpy()[text]), pa.array(place)], names=["key", "short", "place"])

    @tidy
    def meet(batches):
        held = None  # the last row of the batch before, and whether it has been given out
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                rows = [np.concatenate([h, x]) for h, x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            # rows of one anchor that are not all one place of one unit
            new = np.ones(len(rows[0]), dtype=bool)
            new[1:] = rows[0][1:] != rows[0][:-1]
            start = np.flatnonzero(new)
            tail = start[-1]  # the open group goes on in the next batch: keep its first row and its last
            differs = np.zeros(len(rows[0]), dtype=bool)
            differs[1:] = ~new[1:] & ((rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1]))
            several = np.logical_or.reduceat(differs, start)
            give = np.repeat(several, np.diff(np.append(start, len(new))))
            if give.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[1][give]), pa.array(rows[2][give])], names=["short", "place"])
            keep = np.unique([tail, len(new) - 1])
            held = [x[keep] for x in rows]

    short = F.xxhash64("unit").alias("short")
    found = docs.select(short, "text").mapInArrow(find, "key long, short long, place long")
    dealt = found.repartition("key").sortWithinPartitions("key", "short", "place")
    again = dealt.mapInArrow(meet, "short long, place long")
    places = write_table(again.groupBy("short").agg(F.collect_set(F.col("place").cast("int")).alias("places")), "anchors")

    bits = filter_bits(places.count())
    words = slot_filter(places, "short", bits, 1)
    needed = with_membership(docs.withColumn("short", F.xxhash64("unit")), "short", words, bits, "maybe").where("maybe")
    firsts = needed.groupBy("unit").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id")).alias("first"))
    units = needed.select("short", "unit", "id", "text").join(places, "short").join(firsts.withColumnRenamed("unit", "u"), F.col("unit") == F.col("u"))
    units = units.where(F.col("id").eqNullSafe(F.col("first.id"))).dropDuplicates(["unit"])
    units = units.select("unit", F.col("first.no_id").alias("no_id"), F.col("first.id").alias("id"), "places", "text")

    @tidy
    def cut(batches):
        for batch in batches:
            for part, texts in text_slices(batch, 4):
                held = part.column(3).to_pylist()
                text, key, place, first, last = anchors(texts)
                edges = np.searchsorted(text, np.arange(len(texts) + 1))
                keep = np.zeros(len(text), dtype=bool)
                for k in range(len(texts)):
                    a, b = edges[k], edges[k + 1]
                    keep[a:b] = np.isin(place[a:b], np.array(held[k], dtype=np.int64))
                text, key, place, first, last = (x[keep] for x in (text, key, place, first, last))
                pieces = [texts[t][a : b + LENGTH] for t, a, b in zip(text.tolist(), first.tolist(), last.tolist(), strict=True)]
                owner = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(pieces, pa.binary()), *(part.column(i).take(owner) for i in (1, 2, 0)), pa.array(first)],
                    names=["key", "piece", "no_id", "id", "unit", "start"],
                )

    pieces = units.mapInArrow(cut, "key long, piece binary, no_id boolean, id long, unit string, start long")

    @tidy
    def sort(batches):
        entries, held, last_key, last_piece, out = [], 0, None, None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for key, piece, no_id, ident, unit, start in zip(*columns, strict=True):
                if key != last_key:
                    if held >= SHARD_BYTES:
                        out.extend(_repeats(entries))
                        entries, held = [], 0
                elif piece == last_piece:  # all its strings start earlier in the piece before
                    out.append((unit, start, start + len(piece)))
                    continue
                last_key, last_piece = key, piece
                entries.append((piece, unit, (no_id, ident or 0, unit), start))
                held += len(piece)
            if len(out) >= 20_000:
                yield _span_batch(out)
                out = []
        if entries:
            out.extend(_repeats(entries))
        if out:
            yield _span_batch(out)

    shards = pieces.repartition("key").sortWithinPartitions("key", "piece", "no_id", "id", "unit", "start")
    return shards.mapInArrow(sort, "unit string, low long, high long")


def _span_batch(rows) -> pa.RecordBatch:
    unit, low, high = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(unit), pa.array(low), pa.array(high)], names=["unit", "low", "high"])


RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans`` (removed byte runs).

    ``columns`` names those of ``docs`` that are returned, all by default; others, such as a long text, then take
    no part in the joins that bring the results together.

    Texts are UTF-8 bytes, null as empty; strings never cross documents and are judged on the input.  A
    string starts earlier in a smaller doc_id (null comes last; then by the text's MD5), or in
    the same document.  Of rows with equal texts all but the first lose all their bytes if they have
    ``LENGTH`` or more; of rows that agree in doc_id too, any one is the first.  Columns of ``docs`` with
    the names of the results are replaced.  Texts of any length are read whole, one slice of a batch at a time.  doc_id is
    cast to long.  An empty table gives an empty table.
    """
    docs = fresh(docs, *RESULTS)
    ship(docs.sparkSession)
    body = text_of(text)
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.md5(body.cast("binary")).alias("unit"), body.alias("text"))
    spans = repeated_spans(given).groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("found"))
    spans = write_table(spans, "spans")

    bits = filter_bits(spans.count())
    words = slot_filter(spans.select(F.xxhash64("unit").alias("h")), "h", bits, 1)
    needed = with_membership(given.withColumn("h", F.xxhash64("unit")), "h", words, bits, "maybe").where("maybe")
    whole = needed.join(spans.withColumnRenamed("unit", "u"), F.col("unit") == F.col("u")).select("unit", "found", "text")

    @tidy
    def strip(batches):
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        for batch in batches:
            rows = []
            for unit, found, held in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                data, at, kept, runs = held.encode(), 0, [], []
                for span in found:
                    if runs and span["low"] <= runs[-1]["high"]:
                        runs[-1]["high"] = max(runs[-1]["high"], span["high"])
                    else:
                        runs.append({"low": span["low"], "high": span["high"]})
                for run in runs:
                    kept.append(data[at : run["low"]])
                    at = run["high"]
                kept.append(data[at:])
                rows.append((unit, sum(r["high"] - r["low"] for r in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest(), runs))
            if rows:
                unit, removed, count, sha, runs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unit), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha), pa.array(runs, kind)],
                    names=["u", "u_removed", "u_spans", "u_sha", "u_runs"],
                )

    kind = "array<struct<low:bigint,high:bigint>>"
    stripped = whole.dropDuplicates(["unit"]).mapInArrow(strip, f"u string, u_removed long, u_spans long, u_sha string, u_runs {kind}")

    returned = F.struct(*[F.col(f"`{c}`") for c in docs.columns if columns is None or c in columns])
    rows = docs.select(
        returned.alias("row"),
        F.col(doc_id).cast("long").alias("id"),
        F.md5(body.cast("binary")).alias("unit"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.sha2(body.cast("binary"), 256).alias("sha"),
    )
    order = F.struct(F.col("id").isNull().alias("no_id"), "id")
    groups = rows.groupBy(F.col("unit").alias("g")).agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first")).where("copies > 1")
    # of copies that agree in doc_id too, one is the first: they are numbered only where there are any
    same = Window.partitionBy("unit", "id").orderBy(F.lit(1))
    rows = rows.join(groups, F.col("unit") == F.col("g"), "left").join(stripped, F.col("unit") == F.col("u"), "left")
    rows = rows.withColumn("number", F.when(F.col("copies").isNull(), 1).otherwise(F.row_number().over(same)))
    copy = F.col("copies").isNotNull() & ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("number") == 1))
    gone = copy & (F.col("n_bytes") >= LENGTH)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n_bytes").alias("high")))
    return rows.select(
        "row.*",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("u_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("u_spans", F.lit(0))).alias("n_spans"),
        F.when(gone, F.lit(_EMPTY)).otherwise(F.coalesce("u_sha", "sha")).alias("kept_sha256"),
        F.when(gone, all_of_it).otherwise(F.coalesce("u_runs", F.array().cast(kind))).alias("spans"),
    )
