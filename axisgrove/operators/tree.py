"""A balanced k-d tree as a table of nodes.

The tree is a function of the point set: at depth L the axis is L mod D, a segment's lower median in the axis's cyclic
order is its node, smaller points go left and greater ones right. A node's path is its heap code: 1 for the root, 2p and
2p + 1 for the children of p.

Upper levels rank their points by a distributed sort: ranges of (path, super key), row numbers inside a range, and
offsets from the ranges' counts; no segment passes through one task. Once all segments have at most SUBTREE points, one
task for each finishes its subtree. Every level is written to the shared folder, so plans stay short.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import super_key, super_key_less
from ..sources.storage import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUBTREE = 200_000
BROADCAST_RUNS = 500_000
PLACED = "path bigint, node_id bigint, coords array<double>"


def _ranked(seg: DataFrame, axis: int, dims: int) -> DataFrame:
    """seg (path, node_id, coords) with rn, the rank in its path's order of the axis (from 1), and n, the path's size."""
    order = ["path", *(f"k{k}" for k in range(dims)), "node_id"]
    keyed = seg.select("path", "node_id", "coords", *(c.alias(f"k{k}") for k, c in enumerate(super_key(F.col("coords"), axis, dims))))
    parts = int(seg.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    spread = written(spread.select("path", "node_id", "coords", F.monotonically_increasing_id().alias("at")), "sorted")
    part = F.shiftright("at", 33)
    runs = spread.groupBy("path", part.alias("part")).agg(F.count("*").alias("m"), F.min("at").alias("first"))
    w = Window.partitionBy("path").orderBy("part")
    runs = runs.select("path", "part", "first", (F.sum("m").over(w) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("path")).alias("n"))
    runs = runs.withColumnsRenamed({"path": "rpath", "part": "rpart"})
    # one row a path and one more a range that it reaches into
    paths = 1 << len(bin(seg.agg(F.max("path")).first()[0] or 1)) - 3
    return spread.join(F.broadcast(runs) if paths + parts <= BROADCAST_RUNS else runs, (F.col("path") == F.col("rpath")) & (part == F.col("rpart"))).select("path", "node_id", "coords", (F.col("at") - F.col("first") + F.col("before") + 1).alias("rn"), "n")


def _subtree(dims: int):
    def build(t):
        """Places all points of one segment."""
        import pyarrow as pa

        ids = t["node_id"].to_numpy()
        c = np.array(t["coords"].combine_chunks().flatten(), dtype=float).reshape(len(ids), dims)
        path = t["path"].to_numpy().astype(np.int64).copy()
        level = int(path[0]).bit_length() - 1
        left = np.arange(len(ids))
        done = np.zeros(len(ids), dtype=np.int64)
        while len(left):
            axis = level % dims
            order = np.lexsort([c[left, (axis + k) % dims] for k in reversed(range(dims))] + [path[left]])
            left = left[order]
            p = path[left]
            first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            size = np.diff(np.append(first, len(p)))
            rank = np.arange(len(p)) - np.repeat(first, size)
            middle = np.repeat((size - 1) // 2, size)
            done[left[rank == middle]] = p[rank == middle]
            path[left] = 2 * p + (rank > middle)
            left = left[rank != middle]
            level += 1
        return pa.table({"path": pa.array(done), "node_id": pa.array(ids), "coords": t["coords"]})

    return build


def placed(points: DataFrame, dims: int, subtree: int = SUBTREE) -> DataFrame:
    """(path, node_id, coords) of distinct points (point_id, coords)."""
    n = points.count()
    seg = points.select(F.lit(1).cast("bigint").alias("path"), F.col("point_id").alias("node_id"), "coords")
    level, out = 0, None
    while n >> level > subtree:
        ranked = _ranked(seg, level % dims, dims).withColumn("middle", F.expr("(n + 1) div 2"))
        ranked = written(ranked, f"level{level}")
        nodes = ranked.where("rn = middle").select("path", "node_id", "coords")
        out = nodes if out is None else out.unionByName(nodes)
        seg = ranked.where("rn <> middle").select((2 * F.col("path") + (F.col("rn") > F.col("middle")).cast("bigint")).alias("path"), "node_id", "coords")
        level += 1
    rest = seg.groupBy("path").applyInArrow(_subtree(dims), PLACED)
    return written(rest if out is None else out.unionByName(rest), "placed")


def linked(placed_points: DataFrame, dims: int) -> DataFrame:
    """The node table: node_id, point_id, lt_child, gt_child, split_dim, parent, brother, depth, path, coords; what is
    absent is null. One shuffle brings a node to its parent, one the parent's view back."""
    p = placed_points.select("path", "node_id")
    depth = (F.length(F.bin("path")) - 1).cast("int")
    # each parent gets both children, each child its parent and brother
    up = p.where("path > 1").select(F.shiftright("path", 1).alias("up"), "path", "node_id").groupBy("up").agg(
        F.max(F.when(F.col("path") % 2 == 0, F.col("node_id"))).alias("lt_child"), F.max(F.when(F.col("path") % 2 == 1, F.col("node_id"))).alias("gt_child"))
    below = placed_points.join(up, F.col("path") == F.col("up"), "left").select("path", "node_id", "coords", "lt_child", "gt_child")
    above = p.select(F.col("path").alias("apath"), F.col("node_id").alias("parent")).join(up.withColumnsRenamed({"up": "u", "lt_child": "l", "gt_child": "g"}), F.col("apath") == F.col("u")).select("apath", "parent", "l", "g")
    j = below.join(above, F.shiftright("path", 1) == F.col("apath"), "left")
    brother = F.when(F.col("path") % 2 == 0, F.col("g")).otherwise(F.col("l"))
    return j.select("node_id", F.col("node_id").alias("point_id"), "lt_child", "gt_child", (depth % dims).cast("int").alias("split_dim"), "parent", F.when(F.col("parent").isNotNull(), brother).alias("brother"), depth.alias("depth"), "path", "coords")


def verified(nodes: DataFrame, dims: int) -> DataFrame:
    """One row: nodes, roots, max_depth, violations (children on the wrong side of an ancestor's plane of their own
    parent, or with another link back)."""
    child = nodes.select(F.col("node_id").alias("c_id"), F.col("coords").alias("c"), F.col("path").alias("cpath"), F.col("parent").alias("c_parent"))
    j = child.join(nodes.select("path", "node_id", "coords", "split_dim", "lt_child", "gt_child"), F.shiftright("cpath", 1) == F.col("path"))
    left = F.col("cpath") % 2 == 0
    less = super_key_less(F.col("c"), F.col("coords"), F.col("split_dim"), dims)
    more = super_key_less(F.col("coords"), F.col("c"), F.col("split_dim"), dims)
    good = F.when(left, less & (F.col("lt_child") == F.col("c_id"))).otherwise(more & (F.col("gt_child") == F.col("c_id"))) & (F.col("c_parent") == F.col("node_id"))
    bad = j.agg(F.sum((~F.coalesce(good, F.lit(False))).cast("bigint")).alias("v"), F.count("*").alias("edges"))
    whole = nodes.agg(F.count("*").alias("nodes"), F.sum(F.col("parent").isNull().cast("bigint")).alias("roots"), F.max("depth").alias("max_depth"))
    return whole.join(F.broadcast(bad)).select(
        F.col("nodes"), F.coalesce("roots", F.lit(0)).cast("bigint").alias("roots"), F.coalesce("max_depth", F.lit(-1)).cast("int").alias("max_depth"),
        (F.coalesce("v", F.lit(0)) + F.when((F.col("nodes") > 0) & (F.col("edges") + 1 != F.col("nodes")), 1).otherwise(0)).cast("bigint").alias("violations"))


def boxed_violations(nodes: DataFrame, dims: int) -> DataFrame:
    """(node_id, ancestor_id) of nodes on the wrong side of any ancestor: the check of a whole tree. A node meets its
    at most 62 ancestors by their paths."""
    a = nodes.select(F.col("path").alias("apath"), F.col("node_id").alias("ancestor_id"), F.col("coords").alias("a"), F.col("split_dim").alias("axis"))
    n = nodes.where("depth > 0").select("node_id", "coords", "path", "depth", F.explode(F.expr("transform(sequence(1, depth), k -> shiftright(path, k))")).alias("apath"))
    j = n.join(a, "apath")
    left = F.expr("shiftright(path, depth - length(bin(apath))) % 2 = 0")
    good = F.when(left, super_key_less(F.col("coords"), F.col("a"), F.col("axis"), dims)).otherwise(super_key_less(F.col("a"), F.col("coords"), F.col("axis"), dims))
    return j.where(~good).select("node_id", "ancestor_id")


def rendered(nodes: DataFrame) -> DataFrame:
    """The tree on its side: (line, text), greater subtree above, each node indented by its depth. Lines are numbered by
    a range sort and its ranges' counts, not in one task."""
    # in-order position: the path's bits, left-aligned, with the node between its halves
    place = F.expr("-(path * 2 + 1) * shiftleft(1L, 62 - depth - 1)")
    text = F.concat(F.repeat(F.lit("       "), F.col("depth")), F.lit("("), F.array_join(F.transform("coords", lambda x: x.cast("string")), ", "), F.lit(")"))
    spread = nodes.select(place.alias("place"), text.alias("text")).repartitionByRange("place").sortWithinPartitions("place")
    spread = written(spread.withColumn("at", F.monotonically_increasing_id()), "lines")
    part = F.shiftright("at", 33)
    counts = spread.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = counts.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a range
    return spread.join(F.broadcast(before), part == F.col("part")).select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "text")


# --- leaf location

UPPER = 17  # levels that go to every task: 2^17 - 1 nodes at most, of 40 bytes
LOCATE_BLOCK = 50_000


def _descend(top: dict, coords: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where queries at the paths come to in a part of the tree: (path, id of the leaf or -1 if it goes on outside)."""
    path, leaf = at.copy(), np.full(len(at), -1, dtype=np.int64)
    live = np.arange(len(at))
    while len(live) and len(top["path"]):
        k = np.minimum(np.searchsorted(top["path"], path[live]), len(top["path"]) - 1)
        known = top["path"][k] == path[live]
        live, k = live[known], k[known]
        lt, gt = top["lt"][k], top["gt"][k]
        done = ~lt & ~gt
        leaf[live[done]] = top["id"][k[done]]
        live, k, lt, gt = live[~done], k[~done], lt[~done], gt[~done]
        right = np.where(lt & gt, coords[live, top["axis"][k]] >= top["value"][k], gt)
        path[live] = 2 * path[live] + right
    return path, leaf


def _part(t) -> dict:
    order = np.argsort(t["path"].to_numpy())
    take = lambda c: np.array(t[c].to_pylist() if c in ("lt", "gt") else t[c].to_numpy())[order]
    return {"path": take("path"), "id": take("node_id"), "lt": take("lt").astype(bool), "gt": take("gt").astype(bool), "axis": take("split_dim").astype(np.int64), "value": take("value")}


def located(queries: DataFrame, nodes: DataFrame, dims: int, upper: int = UPPER) -> DataFrame:
    """(query_id, node_id) of the leaf that each query (query_id, coords) descends to: left if its coordinate is less
    than the node's, else right; where there is one child, to that. Without nodes there are no rows.

    The upper levels, a bounded number of nodes, go to all tasks and bring each query to a subtree in one pass; queries
    and the subtree's nodes then meet in one cogroup. A subtree with many queries is dealt to several tasks.
    """
    n = nodes.select("path", "node_id", "depth", F.col("lt_child").isNotNull().alias("lt"), F.col("gt_child").isNotNull().alias("gt"), "split_dim", F.element_at("coords", F.col("split_dim") + 1).alias("value"))
    top = queries.sparkSession.sparkContext.broadcast(_part(n.where(F.col("depth") < upper).drop("depth").toArrow()))

    def first(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows and len(top.value["path"]):
                path, leaf = _descend(top.value, np.array(b.column(1).flatten(), dtype=float).reshape(b.num_rows, -1), np.ones(b.num_rows, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(path), pa.array(leaf)], names=["query_id", "coords", "subtree", "node_id"])

    here = queries.select("query_id", "coords").mapInArrow(first, "query_id bigint, coords array<double>, subtree bigint, node_id bigint")
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None or deepest < upper:
        return here.select("query_id", "node_id")

    def second(left, right):
        import pyarrow as pa

        q = left.num_rows
        if not q:
            return pa.table({"query_id": pa.array([], pa.int64()), "node_id": pa.array([], pa.int64())})
        _, leaf = _descend(_part(right), np.array(left["coords"].combine_chunks().flatten(), dtype=float).reshape(q, -1), left["subtree"].to_numpy())
        return pa.table({"query_id": left["query_id"], "node_id": pa.array(leaf)})

    here = written(here, "upper")
    below = here.where("node_id < 0")
    tasks = below.groupBy("subtree").agg(F.ceil(F.count("*") / LOCATE_BLOCK).cast("int").alias("tasks"))
    tasks = F.broadcast(tasks)  # one row a subtree: 2^upper at most
    left = below.join(tasks, "subtree").select("query_id", "coords", "subtree", F.pmod(F.xxhash64("query_id"), "tasks").cast("int").alias("task"))
    lower = n.where(F.col("depth") >= upper).withColumn("subtree", F.expr(f"shiftright(path, depth - {upper})")).join(tasks, "subtree")
    right = lower.select("subtree", "path", "node_id", "lt", "gt", "split_dim", "value", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    found = left.groupBy("subtree", "task").cogroup(right.groupBy("subtree", "task")).applyInArrow(second, "query_id bigint, node_id bigint")
    return here.where("node_id >= 0").select("query_id", "node_id").unionByName(found)
