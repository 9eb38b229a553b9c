"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts with the same set of word shingles are one node.  A node has a signature string of ``DEPTH``
levels in each of ``TREES`` prefix tries; the strings in order are the trie, and the nodes under one
prefix stand together in it.  Nodes that share no prefix of the least useful length with any other
drop out first.  The others descend: matched prefixes start at the deepest level and are shortened by
one level at a time, and every candidate pair that a shortening adds is verified exactly.  From the
similarities of the links found so far follows how many a length misses; shortening stops once the
estimated recall reaches the target.

Groups with the same members count once, over all tries and lengths.  A group goes to tasks in blocks
of bounded size, paired block by block, and its pairs are verified on whole shingle sets; a pair that
meets in several groups is verified in the first.  Texts go to the blocks, where their shingles are cut
anew, since shingles are hashes that no shuffle compresses.  No pair leaves a task: each block gives, for a
node, the links found and the root of its linked group.  Connected components of these stars are the
classes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, packed, ship, text_of, text_slices, tidy, write_table
from tessera.llm.exact_dedup import filter_bits, slot_filter, with_membership
from tessera.llm.shingles import mix, shingle_sets

TREES, DEPTH = 24, 6
#: Bytes of a level in a signature string.
LEVEL = 2
THRESHOLD = 0.8
#: Recall at which matched prefixes are shortened no further.
TARGET_RECALL = 0.99999
#: Nodes, and shingles in all, that one block of a group should hold.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1_000_000


def meeting_odds(similarity, length: int):
    """Probability that two sets of a similarity share a prefix of ``length`` in at least one trie."""
    return 1 - (1 - similarity**length) ** TREES


def least_length(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """Prefix length below which no shortening is needed: even pairs at the threshold meet with the target recall."""
    for length in range(DEPTH, 1, -1):
        if meeting_odds(threshold, length) >= target:
            return length
    return 1


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Signature strings (texts x TREES * DEPTH levels); texts without shingles get zeros."""
    levels = np.zeros((len(counts), TREES * DEPTH), dtype=f">u{LEVEL}")
    full = np.flatnonzero(counts)
    if not len(full):
        return levels
    starts = (np.cumsum(counts) - counts)[full]
    odd = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
    flip = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) + np.uint64(1 << 40))
    for k in range(TREES * DEPTH):
        levels[full, k] = mix(np.minimum.reduceat((values ^ flip[k]) * odd[k], starts)) & np.uint64((1 << 8 * LEVEL) - 1)
    return levels


def prefix_keys(strings: list[bytes], length: int) -> np.ndarray:
    """One number (texts x TREES) for the prefix of each signature string in each trie."""
    levels = np.frombuffer(b"".join(strings), dtype=f">u{LEVEL}").reshape(len(strings), TREES, DEPTH).astype(np.uint64)
    keys = np.zeros((len(strings), TREES), dtype=np.uint64)
    for level in range(length):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + levels[:, :, level] + np.uint64(1))
    return keys


def prefix(length: int) -> Column:
    """The prefix, of ``length`` levels, of the signature string of the trie ``tree``."""
    return F.expr(f"substring(signature, tree * {DEPTH * LEVEL} + 1, {length * LEVEL})")


def signature_table(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, text_hash, node, n, signature) for each row, written in the shared folder."""
    ship(docs.sparkSession)

    @tidy
    def sign(batches):
        for batch in batches:
            for part, texts in text_slices(batch, 2):
                values, counts = shingle_sets(texts)
                edges = np.concatenate([[0], np.cumsum(counts)])
                strings = [row.tobytes() for row in signatures(values, counts)]
                nodes = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array(counts.astype(np.int64)), pa.array(strings, pa.binary())],
                    names=["id", "text_hash", "node", "n", "signature"],
                )

    body = text_of(text)
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.md5(body.cast("binary")).alias("text_hash"), body.alias("text"))
    return write_table(given.mapInArrow(sign, "id long, text_hash string, node binary, n long, signature binary"), "signatures")


def _links(groups, threshold: float, length: int):
    """Verify the groups' candidates: (node, root, weight, found, expected) for each node with links.

    ``found`` counts a block's links and ``expected``, for each length, what links of their similarities
    stand for; both are given with the block's first row alone.
    """
    for tree, same, rows in groups:
        count = len(rows["node"])
        sizes = np.array([len(s) // 8 for s in rows["shingles"]])
        side = np.array(rows["side"])
        copies = np.array(rows["copies"], dtype=np.int64)
        left, right = (np.arange(count),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        if not len(left) or not len(right):  # the other block is empty
            continue
        small, large = np.minimum(sizes[left][:, None], sizes[right][None, :]), np.maximum(sizes[left][:, None], sizes[right][None, :])
        wanted = small >= threshold * large - 1e-9
        if left is right:
            wanted &= np.triu(np.ones((count, count), dtype=bool), 1)
        here = prefix_keys(rows["signature"], length)
        for t in range(tree):  # met in an earlier trie
            wanted &= here[left, t][:, None] != here[right, t][None, :]
        if length < DEPTH:  # met at a longer prefix
            deeper = prefix_keys(rows["signature"], length + 1)
            for t in range(TREES):
                wanted &= deeper[left, t][:, None] != deeper[right, t][None, :]
        if not wanted.any():
            continue
        sets = [np.frombuffer(s, dtype="<u8") for s in rows["shingles"]]
        if wanted.sum() <= 12:
            shared = np.zeros(wanted.shape, dtype=np.int64)
            for i, j in zip(*np.nonzero(wanted), strict=True):
                shared[i, j] = len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True))
        else:
            shared = _shared(sets, left, right)
        total = sizes[left][:, None] + sizes[right][None, :] - shared
        linked = wanted & (shared >= threshold * total - 1e-9)
        if not linked.any():
            continue
        similarity = shared[linked] / total[linked]
        found = int(linked.sum())
        expected = [float((1 / meeting_odds(similarity, k)).sum()) for k in range(1, DEPTH + 1)]
        weight = np.zeros(count, dtype=np.int64)
        np.add.at(weight, left, linked @ copies[right])
        np.add.at(weight, right, linked.T @ copies[left])
        root = np.arange(count)
        i, j = np.nonzero(linked)
        i, j = left[i], right[j]
        while True:
            least = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)
            root = root[root]
            if (root == before).all():
                break
        for k in np.flatnonzero(weight):
            yield rows["node"][k], rows["node"][root[k]], int(weight[k]), found, expected
            found, expected = 0, None


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of intersections, by products of 0/1 matrices over the shingles that two sets or more hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts > 1
    column = (np.cumsum(common) - 1)[inverse]
    held = common[inverse]
    owner, column = owner[held], column[held]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    step = max(1, min(4096, int(common.sum())))
    for begin in range(0, int(common.sum()), step):
        a, b = np.searchsorted(column, [begin, begin + step])
        part = np.zeros((len(sets), step), dtype=np.float32)
        part[owner[a:b], column[a:b] - begin] = 1
        shared += part[left] @ part[right].T
    return shared.astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node with edges: the least node that it is connected to.

    Alternates large and small stars on the edge list, written in the shared folder each round,
    until a round changes nothing.  A hub's edges are aggregated before the shuffle.
    """
    edges = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("x")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), "m")
        joined = large.join(down, F.col("a") == F.col("x"))
        stars = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("x").alias("a"), F.col("m").alias("b")))
        edges = write_table(stars.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def _groups(batches, names: tuple[str, ...]):
    """(tree, one block with itself, rows) for each run of rows of one pair of blocks."""
    current, tree, rows = None, 0, None
    for batch in batches:
        columns = {k: batch.column(k).to_pylist() for k in ("tree", "key", "low", "high", *names)}
        for i in range(batch.num_rows):
            gid = (columns["tree"][i], columns["key"][i], columns["low"][i], columns["high"][i])
            if gid != current:
                if rows is not None and len(rows["node"]) > 1:
                    yield tree, current[2] == current[3], rows
                current, tree, rows = gid, columns["tree"][i], {k: [] for k in names}
            for k in names:
                rows[k].append(columns[k][i])
    if rows is not None and len(rows["node"]) > 1:
        yield tree, current[2] == current[3], rows


def _link_batch(rows) -> pa.RecordBatch:
    kinds = {"node": pa.binary(), "root": pa.binary(), "weight": pa.int64(), "found": pa.int64(), "expected": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _companions(batches):
    """Batches of the prints that stand beside another at their place, from rows (place, print) in this order."""
    held = [np.zeros(0, np.int64)] * 2  # the first and the last row of the place that the batch before left open
    for batch in batches:
        place, prints = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
        if not len(place):
            continue
        start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        stop = np.append(start[1:], len(place))
        several = prints[start] != prints[stop - 1]
        found = np.unique(prints[np.repeat(several, stop - start)])
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["print"])
        ends = [start[-1], len(place) - 1]
        held = [place[ends], prints[ends]]


def _in_company(signed: DataFrame, length: int) -> DataFrame:
    """(print) hashes of the nodes that share a prefix of ``length`` with another in some trie.

    Two numbers for each row and trie go through one shuffle; hashes that collide let a node in that has no company.
    """
    entries = signed.where("n > 0").select("node", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "signature")
    entries = entries.select(F.xxhash64("tree", prefix(length)).alias("place"), F.xxhash64("node").alias("print"))
    dealt = entries.repartition("place").sortWithinPartitions("place", "print")
    return dealt.mapInArrow(tidy(_companions), "print long").distinct()


def _texts(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``wanted`` (node, copies, n, first) with the text of each node's first row and its signature, written in the shared folder.

    A bounded filter keeps all other texts out of the shuffle, and there is one for the texts.
    """
    body = text_of(text)
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.md5(body.cast("binary")).alias("text_hash"), body.alias("text"))
    given = given.select("text_hash", "text", F.xxhash64("id", "text_hash").alias("print"))
    wanted = wanted.select("node", "copies", "n", F.col("first.text_hash").alias("text_hash"), F.xxhash64("first.id", "first.text_hash").alias("print"))
    wanted = write_table(wanted, "wanted")
    bits = filter_bits(wanted.count())
    words = slot_filter(wanted.select("print"), "print", bits, 1)
    given = with_membership(given, "print", words, bits, "maybe").where("maybe").drop("maybe")
    # rows of one text and id are equal, and a text has one node
    held = given.join(wanted, ["text_hash", "print"]).dropDuplicates(["text_hash", "print"]).select("node", "copies", "n", "text")

    @tidy
    def sign(batches):
        for batch in batches:
            for part, texts in text_slices(batch, 3):
                strings = [row.tobytes() for row in signatures(*shingle_sets(texts))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(strings, pa.binary())], names=["node", "copies", "n", "text", "signature"])

    return write_table(held.mapInArrow(sign, "node binary, copies long, n long, text string, signature binary"), "texts")


def _shingled(batches):
    """Batches with the shingles of their texts in place of these."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        names = ["shingles" if k == "text" else k for k in batch.schema.names]
        for part, texts in text_slices(batch, at):
            values, counts = shingle_sets(texts)
            edges = np.concatenate([[0], np.cumsum(counts)])
            sets = [values[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()) if i == at else part.column(i) for i in range(part.num_columns)], names=names)


def _descend(texts: DataFrame, threshold: float, target: float, shortest: int) -> list[DataFrame]:
    """Links (node, root, weight) of every length tried, from the deepest on until the estimated recall reaches the target."""
    names = ("node", "copies", "signature", "shingles", "side")
    every, done = [], None
    for length in range(DEPTH, shortest - 1, -1):
        entries = texts.select("node", "n", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
        entries = entries.select("node", "n", "tree", prefix(length).alias("key"))
        mark = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
        groups = entries.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"), *mark).where("m > 1")
        groups = groups.groupBy("m", "shingles", "mark1", "mark2").agg(F.min(F.struct("tree", "key")).alias("first"))
        if done is not None:  # groups with the members of one that a longer prefix made
            groups = groups.join(done, ["m", "shingles", "mark1", "mark2"], "left_anti")
        blocks = F.greatest(F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
        groups = write_table(groups.select("m", "shingles", "mark1", "mark2", "first.tree", "first.key", blocks.alias("blocks")), "groups")
        marks = groups.select("m", "shingles", "mark1", "mark2")
        done = marks if done is None else done.unionByName(marks)

        members = entries.join(groups.select("tree", "key", "blocks"), ["tree", "key"])
        members = members.groupBy("node").agg(F.collect_list(F.struct("tree", "key", "blocks")).alias("groups"))  # TREES at most
        placed = texts.join(members, "node").withColumn("group", F.explode("groups")).drop("groups")
        placed = placed.withColumn("block", F.expr("cast(pmod(xxhash64(node), group.blocks) as int)"))
        placed = placed.withColumn("other", F.explode(F.expr("sequence(0, group.blocks - 1)")))
        placed = placed.select(
            "group.tree",
            "group.key",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"),
            "node",
            "copies",
            "signature",
            "text",
        )

        def verify(batches, length=length):
            found = []
            for row in _links(_groups(_shingled(batches), names), threshold, length):
                found.append(row)
                if len(found) >= 10_000:
                    yield _link_batch(found)
                    found = []
            if found:
                yield _link_batch(found)

        dealt = placed.repartition("tree", "key", "low", "high").sortWithinPartitions("tree", "key", "low", "high", "node")
        links = dealt.mapInArrow(tidy(verify), "node binary, root binary, weight long, found long, expected array<double>")
        every.append(write_table(links, "links"))
        stands = [F.sum(F.col("expected")[k - 1]).alias(f"e{k}") for k in range(1, DEPTH + 1)]
        sums = [links.agg(F.sum("found").alias("found"), *stands).first() for links in every]
        # a link at the threshold is counted besides those found, so that the estimate needs evidence
        found = 1 + sum(s["found"] or 0 for s in sums)
        expected = 1 / meeting_odds(threshold, length) + sum(s[f"e{length}"] or 0 for s in sums)
        if found / expected >= target:
            break
    return [links.select("node", "root", "weight") for links in every]


def ngram_classes(
    docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id", target: float = TARGET_RECALL
) -> DataFrame:
    """(id, text_hash, root, class_id, n_links, class_rows) for each row of ``docs``.

    Two rows are linked when the Jaccard similarity of their sets of 5-word shingles reaches the
    threshold; a text of one to four words has one shingle of them all.  Rows with equal sets, those without
    words among them (null and empty texts), are linked.  ``class_id`` is the least doc_id of the connected
    class (null where all are null), ``n_links`` the number of rows linked to this one, ``class_rows`` the
    rows of the class.  Repeated rows are rows of one node.  Long texts are read whole, one slice of a batch
    at a time.  No other column of ``docs`` is read, so none can clash.  doc_id is cast to long.  An empty
    table gives an empty table.
    """
    signed = signature_table(docs, text, doc_id)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("first")
    nodes = signed.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), first, F.max("n").alias("n"))
    nodes = write_table(nodes, "nodes")
    shortest = least_length(threshold, target)
    company = write_table(_in_company(signed, shortest), "company")
    texts = _texts(docs, nodes.join(company, F.xxhash64("node") == F.col("print")).drop("print"), text, doc_id)
    rounds = _descend(texts, threshold, target, shortest)
    links = rounds[0]
    for more in rounds[1:]:
        links = links.unionByName(more)
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))

    weights = links.groupBy("node").agg(F.sum("weight").alias("weight"))
    known = nodes.select("node", "copies", F.col("first.no_id").alias("no_id"), F.col("first.id").alias("id"))
    known = known.join(weights, "node", "left").join(roots, "node", "left")
    known = known.select("node", "copies", "no_id", "id", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"))
    classes = known.groupBy("root").agg(F.min(F.struct("no_id", "id")).alias("least"), F.sum("copies").alias("class_rows"))
    known = known.join(classes, "root").select("node", "root", F.col("least.id").alias("class_id"), "n_links", "class_rows")
    return signed.select("id", "text_hash", "node").join(known, "node").select("id", "text_hash", "root", "class_id", "n_links", "class_rows")


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, that with the least doc_id (null comes last), then text hash.

    Rows in a class of their own pass straight through; the others meet their class by a shuffle.  Null
    and empty texts are one class; of repeated rows one stays; all columns of ``docs`` are kept as they are, whatever
    their names.  An empty table gives an empty table.
    """
    classes = write_table(ngram_classes(docs, threshold, text, doc_id).where("class_rows > 1"), "classes")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    stays = classes.groupBy("root").agg(F.min(order).alias("keep")).select("keep.id", "keep.text_hash")
    marked = classes.select("id", "text_hash").distinct()
    kept_key = stays.select(F.xxhash64("id", "text_hash").alias("keep_print"), F.col("id").alias("keep_id"), F.col("text_hash").alias("keep_hash"))

    given = packed(docs, id=F.col(doc_id).cast("long"), text_hash=F.md5(text_of(text).cast("binary")))
    given = given.withColumn("print", F.xxhash64("id", "text_hash"))
    bits = filter_bits(marked.count())
    words = slot_filter(marked.select(F.xxhash64("id", "text_hash").alias("h")), "h", bits, 1)
    given = with_membership(given, "print", words, bits, "maybe")
    alone = given.where(~F.col("maybe")).select("row.*")
    maybe = given.where("maybe")
    pair = marked.select(F.xxhash64("id", "text_hash").alias("mark_print"), F.col("id").alias("mark_id"), F.col("text_hash").alias("mark_hash"))
    keeper = kept_key.withColumn("stays", F.lit(True)).withColumnRenamed("keep_print", "mark_print")
    keeper = pair.join(keeper, (pair.mark_print == keeper.mark_print) & pair.mark_id.eqNullSafe(keeper.keep_id) & (pair.mark_hash == keeper.keep_hash), "left")
    keeper = keeper.select(pair.mark_print, "mark_id", "mark_hash", F.coalesce("stays", F.lit(False)).alias("stays"))
    met = maybe.join(keeper, (F.col("print") == F.col("mark_print")) & F.col("id").eqNullSafe(F.col("mark_id")) & (F.col("text_hash") == F.col("mark_hash")), "left")
    copy = F.row_number().over(Window.partitionBy("print", "text_hash").orderBy(F.lit(1)))
    met = met.where("stays is null or stays").withColumn("copy", copy).where("stays is null or copy = 1")
    return alone.unionByName(met.select("row.*"))
