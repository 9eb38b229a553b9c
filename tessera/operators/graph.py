"""Property-graph operators over ``edges(src, dst[, weight])`` and ``nodes(id)``.

Reshaping and degree operators are plain joins and aggregates.  Iterative operators have plans with
one result: joins over edges that are partitioned once and cut with ``checkpoint`` each round, and numpy
over graphs that tasks hold: the whole graph in one task up to ``ONE_TASK_EDGES`` edges and as many nodes,
and beyond that its weak components side by side, as no edge leads from one to another (``in_parts``).
The counts decide, and the plans are tested against each other.  Depth-first search and Louvain are
sequential within a component: they raise where one component has more than ``COMPONENT_EDGES`` edges.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import ranked

#: Edges, and nodes, that one task may hold (16 bytes each in numpy).
ONE_TASK_EDGES = 2_000_000
#: Edges, and nodes, of one weak component that a task may hold: 4 bytes an edge, 12 with weights.
COMPONENT_EDGES = 150_000_000
#: Small components share a group of about so many edges; a component of more has its own.
GROUP_EDGES = 100_000
#: Edges among three colours of a component that a task holds to count triangles.
TRIANGLE_EDGES = 4_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder that the session names; a local folder only in local mode, where none is set."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return df.checkpoint(eager=True)


def fits_one_task(nodes: DataFrame, edges: DataFrame) -> bool:
    """Is the graph within the bound of the one-task plan?  Counts at most that many edges and nodes."""
    return all(df.select(F.lit(1)).limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES for df in (edges, nodes))


def in_one_task(nodes: DataFrame, edges: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Run ``function(node ids, edges frame)`` on a graph within the bound, in one task."""
    extra = [F.lit(1.0).alias("weight")] if "weight" not in edges.columns else [F.col("weight").cast("double")]
    tagged = edges.select(F.lit(1).alias("kind"), F.col("src").cast("long"), F.col("dst").cast("long"), *extra)
    empty = F.lit(None).cast("long")
    listed = nodes.select(F.lit(0).alias("kind"), F.col("id").cast("long").alias("src"), empty.alias("dst"), F.lit(0.0).alias("weight"))

    def whole(batches):
        frame = pd.concat(list(batches), ignore_index=True)
        ids = np.sort(frame.loc[frame.kind == 0, "src"].to_numpy(dtype=np.int64))
        known = frame[frame.kind == 1].astype({"src": "int64", "dst": "int64"})
        known = known[known.src.isin(ids) & known.dst.isin(ids)].sort_values(["src", "dst"], kind="stable")
        yield function(ids, known[["src", "dst", "weight"]].reset_index(drop=True))

    return tagged.unionByName(listed).coalesce(1).mapInPandas(whole, schema)


def _contracted(edges: DataFrame) -> DataFrame:
    """(id, root, n): each partition's nodes with the least node that its edges link them to, and their out-edges there.

    The weak components of these links are those of the edges, with at most a row for each node and partition.
    """

    def contract(batches):
        import pyarrow as pa

        ids, root, count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, rows = [], 0

        def merged():
            src, dst = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
            every, at = np.unique(np.concatenate([ids, src, dst]), return_inverse=True)
            n = np.bincount(at[len(ids) : len(ids) + len(src)], minlength=len(every))
            n[at[: len(ids)]] += count
            a = np.concatenate([at[: len(ids)], at[len(ids) : len(ids) + len(src)]])
            b = np.concatenate([np.searchsorted(every, root), at[len(ids) + len(src) :]])
            label = np.arange(len(every))
            while True:  # hook roots to lesser ones, then point at roots
                x, y = label[a], label[b]
                open_ = x != y
                if not open_.any():
                    break
                a, b, x, y = a[open_], b[open_], x[open_], y[open_]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(label, label[label]):
                    label = label[label]
            return every, every[label], n

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in (0, 1)))
            rows += batch.num_rows
            if rows >= 1_000_000:
                (ids, root, count), held, rows = merged(), [], 0
        if held:
            ids, root, count = merged()
        for at in range(0, len(ids), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65_536], pa.int64()) for x in (ids, root, count)], ["id", "root", "n"])

    ends = edges.where("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return ends.mapInArrow(contract, "id long, root long, n long")


def _members(nodes: DataFrame | None, edges: DataFrame) -> tuple[DataFrame, int]:
    """(id, component, size) of the nodes, or the ends of edges, in their weak components, size in edges and nodes, and the largest size."""
    links = checkpointed(_contracted(edges))
    ids = links.select("id").distinct() if nodes is None else nodes.select(F.col("id").cast("long").alias("id")).distinct()
    found = connected_components(ids, links.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    found = checkpointed(found)
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    sizes = checkpointed(found.join(counts, "id", "left").groupBy("component").agg((F.sum(F.coalesce("n", F.lit(0))) + F.count(F.lit(1))).alias("size")))
    return found.join(sizes, "component").select("id", "component", "size"), sizes.agg(F.max("size")).first()[0] or 0


def _keyed(members: DataFrame) -> DataFrame:
    """(id, component, size, key): groups of weak components that one task takes; a union of components is a graph as well."""
    sizes = members.select("component", "size").distinct()
    small = sizes.where(F.col("size") < GROUP_EDGES).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = max(1, -(-small // GROUP_EDGES))
    key = F.when(F.col("size") < GROUP_EDGES, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.xxhash64("component"))
    keyed = members.select("id", "component", "size", key.alias("key"))
    few = members.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES
    return F.broadcast(keyed) if few else keyed


def _graphs(batches, weighted: bool):
    """(ids, weights of nodes, begin, dst, weights of edges) of each key, from rows in the order of key, kind, src and dst.

    ``begin`` tells where each node's edges lie in ``dst``, which holds positions in ``ids``; edges that lead elsewhere are left out.
    """
    now, ids, own = None, [], []
    src, dst, cost, rows = [], [], [], 0
    count, ends, costs = None, [], []

    def settle():
        nonlocal ids, own, count
        if count is None:
            ids, own = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((ids, np.int64), (own, float)))
            count = np.zeros(len(ids) + 1, np.int64)

    def flush():
        nonlocal rows
        settle()
        if src and len(ids):
            s, d = np.concatenate(src), np.concatenate(dst)
            i, j = np.minimum(np.searchsorted(ids, s), len(ids) - 1), np.minimum(np.searchsorted(ids, d), len(ids) - 1)
            known = (ids[i] == s) & (ids[j] == d)
            np.add(count[1:], np.bincount(i[known], minlength=len(ids)), out=count[1:])
            ends.append(j[known].astype(np.int32))
            if weighted:
                costs.append(np.concatenate(cost)[known])
        src.clear(), dst.clear(), cost.clear()
        rows = 0

    def made():
        flush()
        out = np.concatenate(ends) if ends else np.zeros(0, np.int32)
        return ids, own, np.cumsum(count), out, np.concatenate(costs) if costs else np.zeros(0 if weighted else len(out))

    for batch in batches:
        keys, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if lo == hi:
                continue
            if now is not None and keys[lo] != now:
                yield made()
                ids, own, count, rows = [], [], None, 0
                ends.clear(), costs.clear()
            now = keys[lo]
            part = batch.slice(lo, hi - lo)
            if kinds[lo] == 0:
                ids.append(part.column(2).to_numpy())
                own.append(part.column(4).to_numpy(zero_copy_only=False))
                continue
            src.append(part.column(2).to_numpy())
            dst.append(part.column(3).to_numpy())
            if weighted:
                cost.append(part.column(4).to_numpy(zero_copy_only=False))
            rows += hi - lo
            if rows >= 1_000_000:
                flush()
    if now is not None:
        yield made()


def in_parts(nodes: DataFrame, edges: DataFrame, function: Callable, schema: str, members: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """Run ``function(ids, node weights, begin, dst, edge weights)`` on the groups of ``members``, or on the whole graph in one task."""
    one = F.lit(1.0)
    given = edges.select(F.lit(0).cast("long").alias("key"), F.lit(1).alias("kind"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), (F.col("weight").cast("double") if weighted and "weight" in edges.columns else one).alias("weight"))
    listed = nodes.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("kind"), F.col("id").cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), (F.col("weight").cast("double") if "weight" in nodes.columns else one).alias("weight"))
    rows = given.where("src is not null and dst is not null").unionByName(listed)
    if members is None:
        rows = rows.coalesce(1)
    else:
        keys = _keyed(members).select(F.col("id").alias("src"), F.col("key").alias("_key"))
        rows = rows.join(keys, "src").select(F.col("_key").alias("key"), "kind", "src", "dst", "weight").repartition("key")

    def run(batches):
        import pyarrow as pa

        for graph in _graphs(batches, weighted):
            found = function(*graph)
            for at in range(0, len(found), 65_536):
                yield pa.RecordBatch.from_pandas(found.iloc[at : at + 65_536], preserve_index=False)

    return rows.sortWithinPartitions("key", "kind", "src", "dst").mapInArrow(run, schema)


def parts(nodes: DataFrame, edges: DataFrame, one_task: bool | None) -> tuple[bool, DataFrame | None]:
    """(do tasks hold the graph, its members where it is split): what ``in_parts`` takes; joins are the other plan."""
    if one_task is not None:
        return one_task, None
    if fits_one_task(nodes, edges):
        return True, None
    members, largest = _members(nodes, edges)
    return largest <= COMPONENT_EDGES, members


def supplier_graph(lineitem: DataFrame) -> DataFrame:
    """Suppliers of consecutive lines of an order: (src, dst, weight), src <> dst, weight the number of such lines."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = lineitem.select(F.lag("l_suppkey").over(order).alias("src"), F.col("l_suppkey").alias("dst"))
    return steps.where("src is not null and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def transpose(edges: DataFrame) -> DataFrame:
    """Edges the other way round."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others)


def self_loops_added(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` and a loop for each node that has none."""
    loops = edges.where("src = dst").select(F.col("src").alias("id"))
    added = nodes.join(loops, "id", "left_anti").select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return edges.select("src", "dst").unionByName(added)


def undirected(edges: DataFrame) -> DataFrame:
    """``edges`` and, once, each reverse edge that is missing; duplicates that were there stay."""
    back = transpose(edges.select("src", "dst")).distinct()
    missing = back.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return edges.select("src", "dst").unionByName(missing.select("src", "dst"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every node; parallel edges count."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    counts = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    zero = F.lit(0).cast("long")
    return nodes.join(counts, "id", "left").select("id", F.coalesce("o", zero).alias("out_degree"), F.coalesce("i", zero).alias("in_degree"))


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density and out-degree statistics.

    ``no_out_edges`` counts nodes without out-edges; ``isolated`` those without any edge.
    """
    d = degrees(nodes, edges)
    n, m = F.count(F.lit(1)), F.sum("out_degree")
    return d.agg(
        n.alias("num_nodes"),
        m.alias("num_edges"),
        F.when(n > 1, m / (n * (n - 1))).otherwise(0.0).alias("density"),
        F.avg("out_degree").alias("avg_degree"),
        F.max("out_degree").alias("max_degree"),
        F.min("out_degree").alias("min_degree"),
        F.percentile("out_degree", 0.5).alias("median_degree"),
        F.var_pop("out_degree").alias("degree_variance"),
        F.count_if(F.col("out_degree") == 0).alias("no_out_edges"),
        F.count_if((F.col("out_degree") == 0) & (F.col("in_degree") == 0)).alias("isolated"),
        F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") > 0)).alias("sources"),
        F.count_if((F.col("out_degree") == 0) & (F.col("in_degree") > 0)).alias("sinks"),
    )


def degree_histogram(nodes: DataFrame, edges: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, lower_edge, num_nodes) of out-degrees in equal bins over [0, max + 1), empty bins included."""
    d = degrees(nodes, edges).select("out_degree")
    width = (F.max("out_degree") + 1) / F.lit(float(bins))
    top = d.agg(F.max("out_degree").alias("top"), width.alias("width"))
    counts = d.join(F.broadcast(top)).groupBy(F.least(F.floor(F.col("out_degree") / F.col("width")), F.lit(bins - 1)).alias("bin"))
    counts = counts.agg(F.count(F.lit(1)).alias("n"))
    every = top.select("width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    every = every.select(F.col("bin").cast("long"), F.floor(F.col("bin") * F.col("width")).alias("lower_edge"))
    return every.join(counts, "bin", "left").select("bin", "lower_edge", F.coalesce("n", F.lit(0)).alias("num_nodes"))


def power_law_exponent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: 1 + n / sum(ln(k / kmin)) over positive out-degrees, 0 where the sum is 0."""
    k = degrees(nodes, edges).where("out_degree > 0").select(F.col("out_degree").alias("k"))
    s = k.agg(F.count(F.lit(1)).alias("n"), F.sum(F.ln("k")).alias("logs"), F.min("k").alias("kmin"))
    total = F.col("logs") - F.col("n") * F.ln("kmin")
    return s.select(F.when(total > 1e-12, 1 + F.col("n") / total).otherwise(0.0).alias("exponent"))


def degree_anomalies(nodes: DataFrame, edges: DataFrame, threshold: float = 2.0) -> DataFrame:
    """z-scores of both degrees (population deviation) and a class for each node.

    Classes: isolated, high_out_degree, low_out_degree, high_in_degree, low_in_degree, hub (both high), none.
    """
    d = degrees(nodes, edges)
    s = d.agg(
        F.avg("out_degree").alias("mo"), F.stddev_pop("out_degree").alias("so"), F.avg("in_degree").alias("mi"), F.stddev_pop("in_degree").alias("si")
    )
    z = d.join(F.broadcast(s))  # one row of statistics
    zo = F.when(F.col("so") > 0, (F.col("out_degree") - F.col("mo")) / F.col("so")).otherwise(0.0)
    zi = F.when(F.col("si") > 0, (F.col("in_degree") - F.col("mi")) / F.col("si")).otherwise(0.0)
    z = z.select("id", "out_degree", "in_degree", zo.alias("out_z"), zi.alias("in_z"))
    t = threshold
    kind = (
        F.when((F.col("out_degree") == 0) & (F.col("in_degree") == 0), "isolated")
        .when((F.col("out_z") > t) & (F.col("in_z") > t), "hub")
        .when(F.col("out_z") > t, "high_out_degree")
        .when(F.col("out_z") < -t, "low_out_degree")
        .when(F.col("in_z") > t, "high_in_degree")
        .when(F.col("in_z") < -t, "low_in_degree")
        .otherwise("none")
    )
    return z.withColumn("anomaly", kind)


def find_hubs(nodes: DataFrame, edges: DataFrame, k: float = 2.0) -> DataFrame:
    """Nodes whose out-degree exceeds the mean by k population deviations."""
    d = degrees(nodes, edges)
    s = d.agg((F.avg("out_degree") + k * F.stddev_pop("out_degree")).alias("limit"))
    return d.join(F.broadcast(s)).where("out_degree > limit").select("id", "out_degree")


def find_peripheral(nodes: DataFrame, edges: DataFrame, max_degree: int = 1) -> DataFrame:
    """Nodes of out-degree at most ``max_degree``."""
    return degrees(nodes, edges).where(F.col("out_degree") <= max_degree).select("id", "out_degree")


def triangle_links(edges: DataFrame) -> DataFrame:
    """(id, links): edges from one distinct out-neighbour of a node to another, parallel ones counted; nodes without any may be missing.

    Tasks hold weak components.  One of more than ``TRIANGLE_EDGES`` edges is dealt by three colours of its nodes: a task holds
    the edges among its colours and counts the triangles that have all three, so each is counted once.
    """
    given = edges.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    if given.select(F.lit(1)).limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES:
        zero = F.lit(0)
        dealt = given.select(zero.cast("long").alias("key"), zero.cast("long").alias("want"), "src", "dst", zero.alias("cs"), zero.alias("cd"), F.lit(1).alias("colours")).coalesce(1)
    else:
        members = _keyed(_members(None, given)[0])
        size = F.col("size")
        colours = F.when(size <= TRIANGLE_EDGES, 1).otherwise(F.ceil(3 * F.sqrt(size / TRIANGLE_EDGES))).cast("int")
        placed = given.join(members.select(F.col("id").alias("src"), "key", colours.alias("colours")), "src")
        colour = [F.pmod(F.xxhash64(c), F.col("colours")).cast("int") for c in ("src", "dst")]
        placed = placed.select("key", "src", "dst", colour[0].alias("cs"), colour[1].alias("cd"), "colours").withColumn("third", F.explode(F.sequence(F.lit(0), F.col("colours") - 1)))
        three = F.array_sort(F.array("cs", "cd", "third"))
        want = ((three[0] * F.col("colours") + three[1]) * F.col("colours") + three[2]).cast("long")
        dealt = placed.select("key", want.alias("want"), "src", "dst", "cs", "cd", "colours").repartition("key", "want")

    def run(batches):
        import pyarrow as pa

        for want, colours, *held in _runs(batches):
            ids, links = _count_links(*held, want, colours)
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(links[some], pa.int64())], ["id", "links"])

    found = dealt.sortWithinPartitions("key", "want").mapInArrow(run, "id long, links long")
    return found.groupBy("id").agg(F.sum("links").alias("links"))


def _runs(batches):
    """(want, colours, src, dst, cs, cd) of each run of rows with one key and want."""
    now, held = None, []

    def made():
        return now[1], int(held[0][4][0]), *(np.concatenate([h[i] for h in held]) for i in range(4))

    for batch in batches:
        key, want, *others = (batch.column(i).to_numpy() for i in range(7))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(want) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
            if lo == hi:
                continue
            if now is not None and now != (key[lo], want[lo]):
                yield made()
                held = []
            now = (key[lo], want[lo])
            held.append([x[lo:hi] for x in others])
    if now is not None:
        yield made()


#: Nodes of a graph that is counted as dense matrices, 4 bytes a pair, and pairs of edges looked up at once.
DENSE_NODES, WEDGES = 4096, 2_000_000


def _count_links(src: np.ndarray, dst: np.ndarray, cs: np.ndarray, cd: np.ndarray, want: int = 0, colours: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(ids, links) over the triangles of three wanted colours: as a product of matrices, or edge pair by edge pair.

    Pairs go out from the end of lower degree, ties by id, so a hub makes no more pairs of them than any other node.
    """
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n, s, d = len(ids), at[: len(src)], at[len(src) :]
    colour = np.zeros(n, np.int64)
    colour[s], colour[d] = cs, cd
    pair, which = np.unique(np.minimum(s, d) * n + np.maximum(s, d), return_inverse=True)
    a, b = pair // n, pair % n
    rises, falls = np.bincount(which[s < d], minlength=len(pair)), np.bincount(which[s > d], minlength=len(pair))
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    order = np.argsort(degree, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    up = rank[a] < rank[b]
    lo, hi = np.where(up, rank[a], rank[b]), np.where(up, rank[b], rank[a])
    out, back = np.where(up, rises, falls), np.where(up, falls, rises)
    by = np.argsort(lo * n + hi)
    lo, hi, out, back = lo[by], hi[by], out[by], back[by]
    begin = np.searchsorted(lo, np.arange(n + 1))
    left = begin[lo + 1] - 1 - np.arange(len(lo))  # further edges of the same node
    through = np.cumsum(left)
    if colours == 1 and n <= DENSE_NODES and len(lo) and through[-1] * 100 > float(n) ** 3:
        times = np.zeros((n, n), np.float32)
        times[lo, hi], times[hi, lo] = out, back
        linked = (times > 0).astype(np.float32)
        links = np.empty(n, np.int64)
        links[order] = np.rint(np.einsum("ij,ij->i", linked @ times, linked, dtype=np.float64)).astype(np.int64)
        return ids, links
    known, colour, found, first = lo * n + hi, colour[order], np.zeros(n), 0
    while first < len(lo):
        last = max(first + 1, int(np.searchsorted(through, (through[first - 1] if first else 0) + WEDGES, "right")))
        one = np.repeat(np.arange(first, last), left[first:last])
        two = np.arange(len(one)) - np.repeat(np.cumsum(left[first:last]) - left[first:last], left[first:last]) + one + 1
        if colours > 1:
            three = np.sort(np.stack([colour[lo[one]], colour[hi[one]], colour[hi[two]]]), axis=0)
            mine = (three[0] * colours + three[1]) * colours + three[2] == want
            one, two = one[mine], two[mine]
        asked = hi[one] * n + hi[two]
        closing = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        real = known[closing] == asked
        one, two, closing = one[real], two[real], closing[real]
        for node, x, y, across in (
            (lo[one], out[one], out[two], out[closing] + back[closing]),
            (hi[one], back[one], out[closing], out[two] + back[two]),
            (hi[two], back[two], back[closing], out[one] + back[one]),
        ):
            found += np.bincount(node, np.where((x > 0) & (y > 0), across, 0), minlength=n)
        first = last
    links = np.empty(n, np.int64)
    links[order] = np.rint(found).astype(np.int64)
    return ids, links


def local_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, coefficient): halved directed links among distinct out-neighbours, doubled, over deg * (deg - 1)."""
    d = degrees(nodes, edges).join(triangle_links(edges), "id", "left")
    k = F.col("out_degree")
    value = F.when(k > 1, F.floor(F.coalesce("links", F.lit(0)) / 2) * 2.0 / (k * (k - 1))).otherwise(0.0)
    return d.select("id", value.alias("coefficient"))


def global_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: triangles i < j < k over pairs of distinct out-neighbours (no factor of three)."""
    e = edges.select("src", "dst").distinct()
    found = triangle_links(e.where("src < dst")).agg(F.coalesce(F.sum("links"), F.lit(0)).alias("triangles"))
    k = F.col("k")
    triplets = e.groupBy("src").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum((k * (k - 1) / 2).cast("long")), F.lit(0)).alias("triplets"))
    return found.join(F.broadcast(triplets)).select(
        "triangles", "triplets", F.when(F.col("triplets") > 0, F.col("triangles") / F.col("triplets")).otherwise(0.0).alias("coefficient")
    )


def csr_row_pointers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, start, stop): where each node's edges lie in an edge list that is sorted by source.

    Prefix sums run over ranges of nodes, so only one row for each range meets in one task.
    """
    d = degrees(nodes, edges).select("id", "out_degree").withColumn("part", F.floor(F.col("id") / 100_000))
    sums = d.groupBy("part").agg(F.sum("out_degree").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    placed = d.withColumn("through", F.sum("out_degree").over(within)).join(starts, "part")
    return placed.select("id", (F.col("base") + F.col("through") - F.col("out_degree")).alias("start"), (F.col("base") + F.col("through")).alias("stop"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, neighbours): sorted neighbour lists of nodes with out-edges.

    A list is one value by its meaning, so a hub's neighbours meet in one row; ``csr_row_pointers`` and the
    edges themselves give the same without that.
    """
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def pagerank(
    nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20, tolerance: float = 1e-6, seeds: DataFrame | None = None, one_task: bool | None = None
) -> DataFrame:
    """(id, score).  Scores sum to 1; the mass of nodes without out-edges goes to all nodes, or to the seeds.

    With ``seeds`` (id) the walk restarts at distinct seeds that are nodes, and starts there.  It stops
    after ``iterations`` rounds or when the scores change by less than ``tolerance`` in all.
    """
    edges = edges.select("src", "dst")
    if one_task is None:
        one_task = fits_one_task(nodes, edges)
    start = nodes.select("id", F.lit(1.0).alias("jump")) if seeds is None else nodes.select("id").join(seeds.select("id").distinct().withColumn("s", F.lit(1.0)), "id", "left")
    if seeds is not None:
        start = start.select("id", F.coalesce("s", F.lit(0.0)).alias("jump"))
    if one_task:
        marked = edges.withColumn("weight", F.lit(1.0)).unionByName(start.where("jump > 0").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(-1.0).alias("weight")))

        def walk(ids, frame):
            n = len(ids)
            jump = np.zeros(n)
            given = frame[frame.weight < 0]
            jump[np.searchsorted(ids, given.src)] = 1
            if not n:
                return pd.DataFrame({"id": ids, "score": np.zeros(0)})
            jump = jump / jump.sum() if jump.sum() else np.full(n, 1 / n)
            real = frame[frame.weight > 0]
            src, dst = np.searchsorted(ids, real.src), np.searchsorted(ids, real.dst)
            out = np.bincount(src, minlength=n)
            score = jump.copy()
            for _ in range(iterations):
                share = np.where(out > 0, score / np.maximum(out, 1), 0)
                new = (1 - damping) * jump + damping * (np.bincount(dst, share[src], minlength=n) + score[out == 0].sum() * jump)
                moved = np.abs(new - score).sum()
                score = new
                if moved < tolerance:
                    break
            return pd.DataFrame({"id": ids, "score": score})

        return in_one_task(nodes, marked, walk, "id long, score double")
    total = start.agg(F.sum("jump")).first()[0] or 0.0
    count = nodes.count()
    share = F.col("jump") / total if total else F.lit(1.0 / max(count, 1))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    base = checkpointed(start.select("id", share.alias("jump")).join(out.withColumnRenamed("src", "id"), "id", "left").withColumn("score", F.col("jump")))
    known = edges.repartition("src").persist()
    lost = base.where("out is null").agg(F.sum("score")).first()[0] or 0.0
    for _ in range(iterations):
        sent = known.join(base.where("out is not null").select(F.col("id").alias("src"), (F.col("score") / F.col("out")).alias("m")), "src")
        got = sent.groupBy(F.col("dst").alias("id")).agg(F.sum("m").alias("m"))
        new = (1 - damping) * F.col("jump") + damping * (F.coalesce("m", F.lit(0.0)) + lost * F.col("jump"))
        base = checkpointed(base.join(got, "id", "left").select("id", "jump", "out", new.alias("score"), F.abs(new - F.col("score")).alias("moved")))
        now = base.agg(F.sum("moved").alias("moved"), F.sum(F.when(F.col("out").isNull(), F.col("score"))).alias("lost")).first()
        lost = now["lost"] or 0.0
        if (now["moved"] or 0.0) < tolerance:
            break
    known.unpersist()
    return base.select("id", "score")


def top_k(scores: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The k rows of highest score, ties by key; k of 0 or less means all."""
    ordered = scores.orderBy(F.desc(score), key)
    return ordered.limit(k) if k > 0 else ordered


def bfs(nodes: DataFrame, edges: DataFrame, sources: list[int]) -> DataFrame:
    """(id, distance, source): hops from the nearest source, -1 where none reaches; ties go to the earlier source.

    Frontiers are joined with the edges round by round; visited nodes are left out by an anti-join.
    """
    spark = nodes.sparkSession
    rows = [(int(s), i) for i, s in enumerate(dict.fromkeys(sources))]
    seen = spark.createDataFrame(rows, "id long, rank int").join(nodes.select("id"), "id").select("id", F.lit(0).alias("distance"), "rank")
    seen = frontier = checkpointed(seen)
    known = edges.select("src", "dst").distinct().repartition("src").persist()
    step = 0
    while True:
        step += 1
        reached = known.join(frontier.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("rank").alias("rank"))
        frontier = checkpointed(reached.join(seen, "id", "left_anti").select("id", F.lit(step).alias("distance"), "rank"))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.unionByName(frontier))
    known.unpersist()
    order = spark.createDataFrame([(i, s) for s, i in rows], "rank int, source long")
    return (
        nodes.join(seen, "id", "left")
        .join(F.broadcast(order), "rank", "left")
        .select("id", F.coalesce("distance", F.lit(-1)).cast("long").alias("distance"), F.coalesce("source", F.lit(-1)).cast("long").alias("source"))
    )


def bfs_tree(nodes: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """(id, distance, parent): hops from ``source`` and the least node one hop nearer; -1 where it does not reach, and for its own parent."""
    found = bfs(nodes, edges, [source]).select("id", "distance")
    near = found.where("distance >= 0")
    steps = edges.select("src", "dst").join(near.select(F.col("id").alias("src"), F.col("distance").alias("ds")), "src")
    steps = steps.join(near.select(F.col("id").alias("dst"), F.col("distance").alias("dd")), "dst").where("dd = ds + 1")
    parents = steps.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    return found.join(parents, "id", "left").select("id", "distance", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"))


def bfs_path(nodes: DataFrame, edges: DataFrame, source: int, target: int) -> DataFrame:
    """(step, id): a shortest path by hops, least nodes first; no rows where there is none, an error for a node that is not there."""
    spark = nodes.sparkSession
    if nodes.where(F.col("id").isin(source, target)).select("id").distinct().count() != len({source, target}):
        raise ValueError("source and target must be nodes")
    tree = checkpointed(bfs_tree(nodes, edges, source))
    at = tree.where(F.col("id") == target).first()
    path = []
    while at is not None and at["distance"] >= 0:  # one lookup for each hop of one path
        path.append((int(at["distance"]), int(at["id"])))
        at = tree.where(F.col("id") == at["parent"]).first() if at["distance"] else None
    return spark.createDataFrame(path, "step long, id long")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): weak components, named by their least node; large and small stars until nothing changes."""
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    state, e = None, checkpointed(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("x")).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), "m")
        stars = large.join(down, F.col("a") == F.col("x")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpointed(stars.unionByName(down.select(F.col("x").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return nodes.join(e.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("b", "id").alias("component"))
        state = now


def _tarjan(ids: np.ndarray, begin: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Least node of each node's strong component, by an explicit stack."""
    n = len(ids)
    number, low, done, comp = [-1] * n, [0] * n, [False] * n, np.arange(n)
    stack, clock = [], 0
    for root in range(n):
        if number[root] >= 0:
            continue
        work = [(root, int(begin[root]))]
        number[root] = low[root] = clock
        clock += 1
        stack.append(root)
        while work:
            v, at = work.pop()
            if at < begin[v + 1]:
                work.append((v, at + 1))
                w = int(dst[at])
                if number[w] < 0:
                    number[w] = low[w] = clock
                    clock += 1
                    stack.append(w)
                    work.append((w, int(begin[w])))
                elif not done[w]:
                    low[v] = min(low[v], number[w])
                continue
            if low[v] == number[v]:
                members = []
                while True:
                    w = stack.pop()
                    done[w] = True
                    members.append(w)
                    if w == v:
                        break
                comp[members] = min(members)
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
    return ids[comp] if n else ids


def strong_components(nodes: DataFrame, edges: DataFrame, one_task: bool | None = None) -> DataFrame:
    """(id, component): strong components, named by their least node.

    By joins, nodes are coloured with the least node that reaches them, and what reaches back within a
    colour is a component; the rest goes round again.
    """
    edges, ids = edges.select("src", "dst"), nodes.select("id")
    held, members = parts(ids, edges, one_task)
    if held:
        return in_parts(ids, edges, lambda ids, _w, begin, dst, _c: pd.DataFrame({"id": ids, "component": _tarjan(ids, begin, dst)}), "id long, component long", members)
    edges = edges.distinct()
    left, rest, found = checkpointed(nodes.select("id")), checkpointed(edges), None
    while not left.isEmpty():
        colour = _spread(left.select("id", F.col("id").alias("c")), rest)
        inside = rest.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        roots = colour.where("id = c")
        back = _spread(roots, transpose(inside.select("src", "dst")), closed=False)
        part = checkpointed(back.select("id", F.col("c").alias("component")))
        found = part if found is None else found.unionByName(part)
        left = checkpointed(left.join(part, "id", "left_anti"))
        keep = left.withColumnRenamed("id", "src")
        rest = checkpointed(rest.join(keep, "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return ids.join(found, "id") if found is not None else ids.select("id", F.col("id").alias("component"))


def _spread(start: DataFrame, edges: DataFrame, closed: bool = True) -> DataFrame:
    """Carry the least colour along edges until nothing changes; ``closed``: every node has one at the start."""
    state, now = None, checkpointed(start)
    while True:
        sent = edges.join(now.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "c")
        now = checkpointed(now.unionByName(sent).groupBy("id").agg(F.min("c").alias("c")))
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("id", "c"))).first()
        if mark == state:
            return now
        state = mark


def cycle_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of nodes on cycles: in a strong component of two or more, or with a self-loop."""
    strong = strong_components(nodes, edges)
    sizes = strong.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(True))
    return strong.join(sizes, "component").join(loops, "id", "left").where("size > 1 or loop").select("id", "component")


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size, id): the members of each strong component of two or more nodes, and self-loops as cycles of one."""
    strong = strong_components(nodes, edges)
    sizes = strong.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = strong.join(sizes, "component")
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct()
    alone = members.where("size = 1").join(loops, "id", "left_semi")
    return members.where("size > 1").unionByName(alone).select("component", "size", "id")


def is_acyclic(nodes: DataFrame, edges: DataFrame) -> bool:
    """Has the graph no cycle?"""
    return cycle_nodes(nodes, edges).isEmpty()


def condensation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between different strong components: (src, dst)."""
    strong = strong_components(nodes, edges)
    a, b = strong.select(F.col("id").alias("src"), F.col("component").alias("cs")), strong.select(F.col("id").alias("dst"), F.col("component").alias("cd"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").where("cs <> cd").select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct()


def break_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One edge for each strong component: the first inner edge of the node with most inner out-edges.

    Taking it away does not promise an acyclic graph; self-loops are ignored.
    """
    strong = strong_components(nodes, edges)
    a, b = strong.select(F.col("id").alias("src"), F.col("component").alias("cs")), strong.select(F.col("id").alias("dst"), F.col("component").alias("cd"))
    inner = edges.select("src", "dst").where("src <> dst").distinct().join(a, "src").join(b, "dst").where("cs = cd")
    best = inner.groupBy("cs", "src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst"))
    return best.groupBy("cs").agg(F.max_by(F.struct("src", "dst"), F.struct("n", -F.col("src"))).alias("e")).select("e.src", "e.dst")


class NotAcyclic(ValueError):
    """The operator needs an acyclic graph."""


def _levels(begin, dst):
    """Nodes in level order and their levels; raises on a cycle."""
    n = len(begin) - 1
    waiting, level = np.bincount(dst, minlength=n), np.zeros(n, np.int64)
    ready, order, depth = np.flatnonzero(waiting == 0), [], 0
    while len(ready):
        level[ready] = depth
        order.append(ready)
        out = np.concatenate([dst[begin[v] : begin[v + 1]] for v in ready])
        np.subtract.at(waiting, out, 1)
        ready, depth = np.unique(out[waiting[out] == 0]), depth + 1
    if sum(map(len, order)) < n:
        raise NotAcyclic("the graph has a cycle")
    return (np.concatenate(order) if order else np.zeros(0, np.int64)), level


def _joined_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level) round by round: nodes without in-edges that are left, and then without these."""
    left, rest, found, level = checkpointed(nodes.select("id")), checkpointed(_inside(nodes, edges)), None, 0
    while not left.isEmpty():
        ready = left.join(rest.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level).cast("long"))
        ready = checkpointed(ready)
        if ready.isEmpty():
            raise NotAcyclic("the graph has a cycle")
        found = ready if found is None else found.unionByName(ready)
        left = checkpointed(left.join(ready.select("id"), "id", "left_anti"))
        rest = checkpointed(rest.join(ready.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    return found if found is not None else nodes.select("id", F.lit(0).cast("long").alias("level"))


def _inside(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between nodes."""
    ids = nodes.select("id")
    return edges.select("src", "dst").distinct().join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select("src", "dst")


def _relaxed(start: DataFrame, edges: DataFrame, best: Callable, step: Column) -> DataFrame:
    """(id, t): ``best`` (min or max) over all ways of ``step`` (an expression of t and the edge), until a round changes nothing."""
    known = edges.repartition("src").persist()
    now = changed = checkpointed(start)
    while not changed.isEmpty():
        sent = known.join(changed.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), step.alias("t"))
        offered = sent.groupBy("id").agg(best("t").alias("new"))
        merged = checkpointed(now.join(offered, "id", "full_outer").select("id", F.col("t").alias("old"), (F.greatest if best is F.max else F.least)("t", "new").alias("t")))
        changed = merged.where(~F.col("t").eqNullSafe(F.col("old"))).select("id", "t")
        now = merged.select("id", "t")
    known.unpersist()
    return now


def topological_levels(nodes: DataFrame, edges: DataFrame, one_task: bool | None = None) -> DataFrame:
    """(id, level, position): longest distance from a source, and a topological position in (level, id) order."""

    def run(ids, _weights, begin, dst, _costs):
        order, level = _levels(begin, dst)
        position = np.empty(len(ids), np.int64)
        position[order] = np.arange(len(ids))
        return pd.DataFrame({"id": ids, "level": level, "position": position})

    ids = nodes.select("id")
    held, members = parts(ids, edges, one_task)
    if held and members is None:
        return in_parts(ids, edges, run, "id long, level long, position long")
    levels = checkpointed(in_parts(ids, edges, run, "id long, level long, position long", members).select("id", "level")) if held else _joined_levels(nodes, edges)
    return ranked(levels, ["level", "id"], "position").select("id", "level", "position")


def critical_path(nodes: DataFrame, edges: DataFrame, one_task: bool | None = None) -> DataFrame:
    """(id, earliest, latest, slack, critical) with node weights from ``nodes.weight`` (1 where there is none)."""
    weight = F.col("weight").cast("double") if "weight" in nodes.columns else F.lit(1.0)
    held, members = parts(nodes, edges, one_task)
    if not held:
        return _joined_critical_path(nodes.select("id", weight.alias("w")), edges)

    def run(ids, cost, begin, dst, _costs):
        n = len(ids)
        order, _ = _levels(begin, dst)
        early, tail = np.zeros(n), cost.copy()
        for v in order:
            out = dst[begin[v] : begin[v + 1]]
            early[out] = np.maximum(early[out], early[v] + cost[v])
        for v in order[::-1]:
            out = dst[begin[v] : begin[v + 1]]
            if len(out):
                tail[v] = tail[out].max() + cost[v]
        return pd.DataFrame({"id": ids, "earliest": early, "tail": tail})

    found = in_parts(nodes.select("id", weight.alias("weight")), edges, run, "id long, earliest double, tail double", members)
    return _with_slack(found if members is None else checkpointed(found))


def _with_slack(ways: DataFrame) -> DataFrame:
    """(id, earliest, latest, slack, critical) of the longest ways to nodes and, as ``tail``, from them to their ends."""
    total = ways.agg(F.max(F.col("earliest") + F.col("tail")).alias("total"))
    latest = F.col("total") - F.col("tail")
    slack = latest - F.col("earliest")
    return ways.crossJoin(F.broadcast(total)).select("id", "earliest", latest.alias("latest"), slack.alias("slack"), (slack <= 1e-9).alias("critical"))  # one row of totals


def _joined_critical_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest ways from the sources and to the sinks by relaxation; a cycle is found first."""
    _joined_levels(nodes, edges)
    inner = _inside(nodes, edges)
    costed = inner.join(nodes.select(F.col("id").alias("src"), F.col("w").alias("cs")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("w").alias("cd")), "dst")
    early = _relaxed(nodes.select("id", F.lit(0.0).alias("t")), costed, F.max, F.col("t") + F.col("cs"))
    back = costed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cs").alias("own"))
    tail = _relaxed(nodes.select("id", F.col("w").alias("t")), back, F.max, F.col("t") + F.col("own"))
    return _with_slack(early.withColumnRenamed("t", "earliest").join(tail.withColumnRenamed("t", "tail"), "id"))


def dag_shortest_path(nodes: DataFrame, edges: DataFrame, source: int, one_task: bool | None = None) -> DataFrame:
    """(id, cost, parent) from ``source``, where entering a node costs its ``weight``; null cost where unreachable."""
    weight = F.col("weight").cast("double") if "weight" in nodes.columns else F.lit(1.0)
    held, members = parts(nodes, edges, one_task)
    if not held:
        return _joined_shortest_path(nodes.select("id", weight.alias("w")), edges, source)

    def run(ids, enter, begin, dst, _costs):
        n = len(ids)
        order, _ = _levels(begin, dst)
        cost, parent = np.full(n, np.inf), np.full(n, -1)
        at = np.searchsorted(ids, source)
        if at < n and ids[at] == source:
            cost[at] = 0
        for v in order:
            if np.isfinite(cost[v]):
                out = dst[begin[v] : begin[v + 1]]
                new = cost[v] + enter[out]
                with np.errstate(invalid="ignore"):
                    better = (new < cost[out] - 1e-12) | ((np.abs(new - cost[out]) <= 1e-12) & (ids[v] < parent[out]))
                cost[out[better]], parent[out[better]] = new[better], ids[v]
        return pd.DataFrame({"id": ids, "cost": np.where(np.isfinite(cost), cost, np.nan), "parent": parent})

    frame = in_parts(nodes.select("id", weight.alias("weight")), edges, run, "id long, cost double, parent long", members)
    return frame.withColumn("cost", F.when(F.isnan("cost"), None).otherwise(F.col("cost")))


def _joined_shortest_path(nodes: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """Least costs by relaxation; the parent is the least node over which a node's cost is reached."""
    _joined_levels(nodes, edges)
    costed = _inside(nodes, edges).join(nodes.select(F.col("id").alias("dst"), F.col("w").alias("enter")), "dst")
    reached = _relaxed(nodes.where(F.col("id") == source).select("id", F.lit(0.0).alias("t")), costed, F.min, F.col("t") + F.col("enter"))
    ends = costed.join(reached.select(F.col("id").alias("src"), F.col("t").alias("ts")), "src").join(reached.select(F.col("id").alias("dst"), F.col("t").alias("td")), "dst")
    parents = ends.where(F.abs(F.col("ts") + F.col("enter") - F.col("td")) <= 1e-12).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    return nodes.join(reached, "id", "left").join(parents, "id", "left").select("id", F.col("t").alias("cost"), F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"))


def _sequential(nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """The members to split the graph by for an operator that takes a component at a time; None where one task holds all."""
    held, members = parts(nodes, edges, None)
    if not held:
        raise ValueError(f"a sequential operator takes at most {COMPONENT_EDGES} edges and nodes of one component")
    return members


def depth_first(nodes: DataFrame, edges: DataFrame, source: int | None = None) -> DataFrame:
    """(id, parent, discovery, finish): depth-first search, neighbours by id; one clock counts both times.

    From ``source`` alone, or from every node in turn where it is None.  A tree stays within a weak component and takes
    the clock for twice its nodes at a stretch: components are searched side by side, and each tree begins where those
    of lesser roots end.
    """

    def run(ids, _weights, begin, dst, _costs):
        n, begin = len(ids), begin.tolist()
        found, finish, parent, tree, clock = [-1] * n, [-1] * n, [-1] * n, [-1] * n, 0
        for root in range(n) if source is None else [int(np.searchsorted(ids, source))]:
            if root >= n or found[root] >= 0 or (source is not None and ids[root] != source):
                continue
            found[root], tree[root], clock = 0, root, 1
            work, ats = [root], [begin[root]]
            while work:
                v, at, end = work[-1], ats[-1], begin[work[-1] + 1]
                while at < end and found[w := int(dst[at])] >= 0:
                    at += 1
                if at < end:
                    ats[-1] = at + 1
                    found[w], parent[w], tree[w], clock = clock, v, root, clock + 1
                    work.append(w)
                    ats.append(begin[w])
                else:
                    finish[v], clock = clock, clock + 1
                    work.pop(), ats.pop()
        named = [np.where(np.array(x) < 0, -1, ids[np.array(x, np.int64)]) if n else ids for x in (parent, tree)]
        return pd.DataFrame({"id": ids, "parent": named[0], "discovery": found, "finish": finish, "tree": named[1], "seen": np.array(tree) >= 0})

    ids = nodes.select("id")
    members = _sequential(ids, edges)
    found = checkpointed(in_parts(ids, edges, run, "id long, parent long, discovery long, finish long, tree long, seen boolean", members))
    sizes = found.where("seen").groupBy("tree").agg((2 * F.count(F.lit(1))).alias("ticks"))
    ranged = checkpointed(sizes.repartitionByRange("tree").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range meets in one task
    bases = ranged.groupBy("_part").agg(F.min("tree").alias("_low"), F.sum("ticks").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = F.sum("ticks").over(Window.partitionBy("_part").orderBy("tree")) - F.col("ticks")
    starts = ranged.withColumn("_within", within).join(F.broadcast(bases), "_part").select("tree", (F.col("_base") + F.col("_within")).alias("start"), F.lit(True).alias("seen"))
    late = F.coalesce("start", F.lit(0))
    return found.join(starts, ["tree", "seen"], "left").select("id", "parent", (F.col("discovery") + late).alias("discovery"), (F.col("finish") + late).alias("finish"))


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, passes: int = 100) -> DataFrame:
    """(id, community): local moving by modularity gain in id order, ties to the least community; edges are symmetrised.

    Communities are numbered by their least node.  A node only moves to communities of its neighbours, and what it gains
    depends on them and on the weight of all edges: weak components are moved side by side, each in the order of its ids.
    """
    members = _sequential(nodes, edges)
    ids = nodes.select("id")
    known = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = known.select(ends.alias("e"), weight.alias("weight")).groupBy("e.src", "e.dst").agg(F.max("weight").alias("weight"))
    total = both.agg(F.sum("weight")).first()[0] or 0.0

    def run(ids, _weights, begin, dst, w):
        n = len(ids)
        src = np.repeat(np.arange(n, dtype=np.int32), np.diff(begin))
        k = np.bincount(src, w, minlength=n)
        comm, size = np.arange(n), k.copy()
        for _ in range(passes if total else 0):
            moved = False
            for v in range(n):
                near = dst[begin[v] : begin[v + 1]]
                if not len(near):
                    continue
                own = comm[v]
                options, at = np.unique(np.append(comm[near], own), return_inverse=True)
                gain = np.bincount(at, np.append(np.where(near == v, 0.0, w[begin[v] : begin[v + 1]]), 0.0))
                size[own] -= k[v]
                score = gain - resolution * k[v] * size[options] / total
                best = score.argmax()
                if score[best] > score[at[-1]] + 1e-12:
                    comm[v], moved = options[best], True
                size[comm[v]] += k[v]
            if not moved:
                break
        least = np.full(n, n)
        np.minimum.at(least, comm, np.arange(n))
        return pd.DataFrame({"id": ids, "community": ids[least[comm]] if n else ids})

    return in_parts(ids, both, run, "id long, community long", members, weighted=True)


def community_stats(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, size, internal_weight, total_weight, density) for (id, community); inner edges count half each way."""
    size = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    a, b = communities.select(F.col("id").alias("src"), F.col("community").alias("cs")), communities.select(F.col("id").alias("dst"), F.col("community").alias("cd"))
    w = edges.join(a, "src").join(b, "dst").groupBy(F.col("cs").alias("community"))
    w = w.agg((F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0)) / 2).alias("internal"), F.sum("weight").cast("double").alias("total"))
    s = F.col("size")
    internal = F.coalesce("internal", F.lit(0.0))
    density = F.when(s > 1, internal / (s * (s - 1) / 2)).otherwise(1.0)
    return size.join(w, "community", "left").select("community", "size", internal.alias("internal_weight"), F.coalesce("total", F.lit(0.0)).alias("total_weight"), density.alias("density"))


def inter_community(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(c1, c2, weight): summed weight of edges from one community to another."""
    a, b = communities.select(F.col("id").alias("src"), F.col("community").alias("c1")), communities.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    return edges.join(a, "src").join(b, "dst").where("c1 <> c2").groupBy("c1", "c2").agg(F.sum("weight").cast("double").alias("weight"))


def edge_modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: sum over existing edges within communities of (w - resolution * ki * kj / 2m) / 2m, and the textbook value."""
    k = edges.groupBy("src").agg(F.sum("weight").alias("k"))
    total = edges.agg(F.sum("weight").cast("double").alias("m2"))
    a = communities.join(k.withColumnRenamed("src", "id"), "id", "left").select("id", "community", F.coalesce("k", F.lit(0)).alias("k"))
    left, right = a.toDF("src", "cs", "ks"), a.toDF("dst", "cd", "kd")
    inner = edges.join(left, "src").join(right, "dst").where("cs = cd").join(F.broadcast(total))
    on_edges = inner.agg(F.sum((F.col("weight") - resolution * F.col("ks") * F.col("kd") / F.col("m2")) / F.col("m2")).alias("edge_modularity"), F.sum(F.col("weight") / F.col("m2")).alias("inside"))
    whole = a.groupBy("community").agg(F.sum("k").alias("k")).join(F.broadcast(total)).agg(F.sum(resolution * F.pow(F.col("k") / F.col("m2"), F.lit(2.0))).alias("expected"))
    return on_edges.join(F.broadcast(whole)).select("edge_modularity", (F.col("inside") - F.col("expected")).alias("modularity"))
