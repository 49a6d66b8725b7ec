"""Proximity joins: nearest, k nearest, radius, box. Every strategy gives the same rows.

Order of neighbours: (squared distance, point_id). The ball is open, the box closed. Pruning for nearest neighbours keeps
what is as far as the bound, since an equal distance with a lower id wins.

brute   a cross join with the broadcast points, ranked by a window (Spark keeps k rows a query on both sides of the
        shuffle); for small products.
block   queries and points in hashed blocks; a task gets a block of each and computes distances with NumPy, axis by axis,
        in double. Exact at any dimension, for boxes too; memory is two blocks.
grid    radius and box in few dimensions: cells as wide as the radius, a query meets the 3^D cells around it in an
        equi-join. A merge join, so that neither side passes through the driver; hot cells are split by AQE.
cells   k nearest in few dimensions: disjoint boxes from a bounded sample's medians; a query searches its own box, then
        the boxes that its bound reaches. The sample decides the balance, never the result. Cells with many queries are
        searched in several tasks.
"""

from __future__ import annotations

import itertools
import sys
from functools import reduce
from operator import and_

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import squared_distance, squared_distance_columns, within_ball, within_box
from ..sources.storage import removed, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERY_BLOCK, POINT_BLOCK = 20_000, 50_000
TASK_PAIRS, MOST_PARTS = 20_000_000, 64
CELL_POINTS, MOST_CELLS, SAMPLE = 20_000, 4096, 100_000
FEW_POINTS = 1_000  # a cell of a small set, so that it has cells at all
FOUND = "query_id bigint, point_id bigint, dist2 double"


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank from 1, point_id, dist2) of the k nearest of found (query_id, point_id, dist2)."""
    w = Window.partitionBy("query_id").orderBy("dist2", "point_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "point_id", "dist2")


# --- brute force


def _pairs(queries: DataFrame, points: DataFrame) -> DataFrame:
    q = queries.select("query_id", F.col("coords").alias("q"))
    return q.crossJoin(F.broadcast(points.select("point_id", "coords"))).withColumn("dist2", squared_distance(F.col("q"), F.col("coords")))


def knn_brute(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    return ranked(_pairs(queries, points).select("query_id", "point_id", "dist2"), k)


def radius_brute(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    return _pairs(queries, points).where(within_ball(F.col("dist2"), radius)).select("query_id", "point_id", "dist2")


def box_brute(queries: DataFrame, points: DataFrame, cut: float) -> DataFrame:
    return _pairs(queries, points).where(within_box(F.col("q"), F.col("coords"), cut)).select("query_id", "point_id")


# --- kernels over two Arrow tables


def _matrix(t, name: str = "coords") -> np.ndarray:
    n = t.num_rows
    return np.array(t[name].combine_chunks().flatten(), dtype=float).reshape(n, -1) if n else np.zeros((0, 1))


def _chunks(q: np.ndarray, p: np.ndarray, most: int = 4_000_000):
    """(first row, squared distances) of runs of queries."""
    step = max(1, most // max(1, len(p)))
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        d2 = np.zeros((len(part), len(p)))
        for j in range(p.shape[1]):
            d = part[:, j, None] - p[None, :, j]
            d2 += d * d
        yield lo, d2


def _result(rows: list):
    import pyarrow as pa

    cat = lambda k, t: np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, dtype=t)
    return pa.table({"query_id": pa.array(cat(0, np.int64)), "point_id": pa.array(cat(1, np.int64)), "dist2": pa.array(cat(2, float))})


def knn_kernel(k: int):
    def run(left, right):
        q, p = _matrix(left), _matrix(right)
        rows: list = []
        if len(q) and len(p):
            qid, pid = left["query_id"].to_numpy(), right["point_id"].to_numpy()
            for lo, d2 in _chunks(q, p):
                m = min(k, len(p))
                bound = np.partition(d2, m - 1, axis=1)[:, m - 1]
                i, j = np.nonzero(d2 <= bound[:, None])
                order = np.lexsort((pid[j], d2[i, j], i))
                i, j = i[order], j[order]
                at = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[at < m], j[at < m]
                rows.append((qid[lo + i], pid[j], d2[i, j]))
        return _result(rows)

    return run


def radius_kernel(radius: float):
    r2 = float(radius) * float(radius)

    def run(left, right):
        q, p = _matrix(left), _matrix(right)
        rows: list = []
        if len(q) and len(p):
            qid, pid = left["query_id"].to_numpy(), right["point_id"].to_numpy()
            for lo, d2 in _chunks(q, p):
                i, j = np.nonzero(d2 < r2)
                rows.append((qid[lo + i], pid[j], d2[i, j]))
        return _result(rows)

    return run


def box_kernel(cut: float):
    cut = float(cut)

    def run(left, right):
        q, p = _matrix(left), _matrix(right)
        rows: list = []
        if len(q) and len(p):
            qid, pid = left["query_id"].to_numpy(), right["point_id"].to_numpy()
            step = max(1, 4_000_000 // len(p))
            for lo in range(0, len(q), step):
                part = q[lo : lo + step]
                inside = np.ones((len(part), len(p)), dtype=bool)
                for j in range(p.shape[1]):
                    inside &= np.abs(part[:, j, None] - p[None, :, j]) <= cut
                i, j = np.nonzero(inside)
                rows.append((qid[lo + i], pid[j], np.zeros(len(i))))
        return _result(rows)

    return run


# --- blocks


def _block_join(queries: DataFrame, points: DataFrame, kernel, n: int, q: int) -> DataFrame:
    nb, qb = max(1, -(-n // POINT_BLOCK)), max(1, -(-q // QUERY_BLOCK))
    # a product of one block is dealt to more tasks by its queries, each of which takes all points
    qb = max(qb, min(MOST_PARTS, -(-n * q // TASK_PAIRS) // nb))
    left = queries.select("query_id", "coords", F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("pb"))
    right = points.select("point_id", "coords", F.pmod(F.xxhash64("point_id"), F.lit(nb)).cast("int").alias("pb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    return left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInArrow(kernel, FOUND)


def knn_block(queries: DataFrame, points: DataFrame, k: int, n: int, q: int) -> DataFrame:
    return ranked(_block_join(queries, points, knn_kernel(k), n, q), k)


def radius_block(queries: DataFrame, points: DataFrame, radius: float, n: int, q: int) -> DataFrame:
    return _block_join(queries, points, radius_kernel(radius), n, q)


def box_block(queries: DataFrame, points: DataFrame, cut: float, n: int, q: int) -> DataFrame:
    return _block_join(queries, points, box_kernel(cut), n, q).select("query_id", "point_id")


# --- grid


def _axes(name: str, dims: int) -> list:
    return [F.col(f"{name}{j}") for j in range(dims)]


def _grid_pairs(queries: DataFrame, points: DataFrame, width: float, dims: int) -> DataFrame:
    """(query_id, q0, q1, …, point_id, p0, p1, …) of all pairs in cells that touch: a column an axis, since pairs are
    many and generated code has no functions over arrays."""
    side = lambda df, i, n: df.select(i, *(F.col("coords")[j].alias(f"{n}{j}") for j in range(dims)))
    cell = lambda n, j: F.floor(F.col(f"{n}{j}") / F.lit(width)).cast("bigint")
    around = F.array(*(F.struct(*(F.lit(s).cast("bigint").alias(f"s{j}") for j, s in enumerate(o))) for o in itertools.product((-1, 0, 1), repeat=dims)))
    q = side(queries, "query_id", "q").withColumn("o", F.explode(around))
    q = q.select("query_id", *_axes("q", dims), *((cell("q", j) + F.col("o")[f"s{j}"]).alias(f"c{j}") for j in range(dims)))
    p = side(points, "point_id", "p").select("*", *(cell("p", j).alias(f"c{j}") for j in range(dims)))
    # a merge join in any case: Spark judges by the compressed file, and would send a million points through the driver
    return q.join(p.hint("merge"), [f"c{j}" for j in range(dims)])


def radius_grid(queries: DataFrame, points: DataFrame, radius: float, dims: int) -> DataFrame:
    # cells a hair wider than the radius, so that rounding of the quotient cannot part neighbours
    j = _grid_pairs(queries, points, radius * (1 + 1e-9), dims).withColumn("dist2", squared_distance_columns(_axes("q", dims), _axes("p", dims)))
    return j.where(within_ball(F.col("dist2"), radius)).select("query_id", "point_id", "dist2")


def box_grid(queries: DataFrame, points: DataFrame, cut: float, dims: int) -> DataFrame:
    j = _grid_pairs(queries, points, cut * (1 + 1e-9) or 1.0, dims)
    near = [F.abs(a - b) <= F.lit(float(cut)) for a, b in zip(_axes("q", dims), _axes("p", dims), strict=True)]
    return j.where(reduce(and_, near)).select("query_id", "point_id")


# --- cells


class Cells:
    """Disjoint half-open boxes that cover the space, from medians of a sample."""

    def __init__(self, sample: np.ndarray, many: int) -> None:
        dims = sample.shape[1]
        self.axis, self.value, self.low, self.high, boxes = [], [], [], [], []
        todo = [(sample, np.full(dims, -np.inf), np.full(dims, np.inf), many)]
        self.children: list[list[int]] = []
        work = [(0, *todo[0])]
        self.axis.append(-1)
        self.value.append(0.0)
        self.children.append([-1, -1])
        while work:
            at, s, lo, hi, m = work.pop()
            spread = np.ptp(s, axis=0) if len(s) else np.zeros(dims)
            j = int(spread.argmax())
            v = float(np.median(s[:, j])) if len(s) > 1 else 0.0
            if m <= 1 or len(s) < 2 or spread[j] == 0 or not (s[:, j] < v).any():
                self.value[at] = float(len(boxes))
                boxes.append((lo, hi))
                continue
            self.axis[at], self.value[at] = j, v
            for side, part in enumerate((s[s[:, j] < v], s[s[:, j] >= v])):
                l2, h2 = lo.copy(), hi.copy()
                (h2 if side == 0 else l2)[j] = v
                self.axis.append(-1)
                self.value.append(0.0)
                self.children.append([-1, -1])
                self.children[at][side] = len(self.axis) - 1
                work.append((len(self.axis) - 1, part, l2, h2, m // 2 if side == 0 else m - m // 2))
        self.low, self.high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
        self.axis, self.value, self.children = np.array(self.axis), np.array(self.value), np.array(self.children)

    def __len__(self) -> int:
        return len(self.low)

    def of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            axis = self.axis[at]
            inner = axis >= 0
            if not inner.any():
                return self.value[at].astype(np.int64)
            rows = np.flatnonzero(inner)
            at[rows] = self.children[at[rows], (x[rows, axis[rows]] >= self.value[at[rows]]).astype(int)]

    def lower(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each row to each box, a bound from below."""
        out = np.zeros((len(x), len(self)))
        for j in range(x.shape[1]):
            d = np.maximum(np.maximum(self.low[:, j] - x[:, j, None], x[:, j, None] - self.high[:, j]), 0)
            out += d * d
        return out


def _with_cell(df: DataFrame, cells: Cells, id_col: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array(b.column(1).flatten(), dtype=float).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells.of(x) if len(x) else np.zeros(0, dtype=np.int64))], names=[id_col, "coords", "cell"])

    return df.select(id_col, "coords").mapInArrow(run, f"{id_col} bigint, coords array<double>, cell bigint")


def _cell_join(queries: DataFrame, points: DataFrame, kernel) -> DataFrame:
    """The kernel over queries (query_id, coords, cell) and points (point_id, coords, cell) of one cell; a cell's
    queries are dealt to as many tasks as they need, and its points go to each."""
    size = queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("tasks"))
    size = F.broadcast(size)  # one row a cell: at most MOST_CELLS
    left = queries.join(size, "cell").select("query_id", "coords", "cell", F.pmod(F.xxhash64("query_id"), F.col("tasks")).cast("int").alias("task"))
    right = points.join(size, "cell").select("point_id", "coords", "cell", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    return left.groupBy("cell", "task").cogroup(right.groupBy("cell", "task")).applyInArrow(kernel, FOUND)


def knn_cells(queries: DataFrame, points: DataFrame, k: int, n: int, cell_points: int = CELL_POINTS) -> DataFrame:
    share = min(1.0, SAMPLE / max(1, n))
    sample = points.select("coords").sample(share, 1).limit(2 * SAMPLE).toArrow()
    x = np.array(sample["coords"].combine_chunks().flatten(), dtype=float).reshape(sample.num_rows, -1)
    size = max(min(cell_points, max(FEW_POINTS, n // 64)), 2 * k)
    cells = Cells(x, int(min(MOST_CELLS, max(1, n // size))))
    kept: list[str] = []
    p = written(_with_cell(points, cells, "point_id"), "points", kept)
    q = written(_with_cell(queries, cells, "query_id"), "queries", kept)
    home = written(_cell_join(q, p, knn_kernel(k)), "home", kept)
    w = home.groupBy("query_id").agg(F.max("dist2").alias("bound"), F.count("*").alias("got"))
    bounded = q.join(w, "query_id", "left").select("query_id", "coords", "cell", F.when(F.col("got") >= k, F.col("bound")).otherwise(F.lit(float("inf"))).alias("bound"))

    def reached(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array(b.column(1).flatten(), dtype=float).reshape(b.num_rows, -1)
            own, bound = b.column(2).to_numpy(), b.column(3).to_numpy()
            for lo in range(0, len(x), 1000):
                hit = cells.lower(x[lo : lo + 1000]) <= bound[lo : lo + 1000, None]
                hit[np.arange(len(hit)), own[lo : lo + 1000]] = False
                i, j = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + i)), b.column(1).take(pa.array(lo + i)), pa.array(j)], names=["query_id", "coords", "cell"])

    more = bounded.mapInArrow(reached, "query_id bigint, coords array<double>, cell bigint")
    found = written(ranked(home.unionByName(_cell_join(written(more, "reached", kept), p, knn_kernel(k))), k), "found")
    removed(points.sparkSession, kept)
    return found


# --- views of results


def neighbour_arrays(found: DataFrame) -> DataFrame:
    """(query_id, point_ids) of k nearest, nearest first."""
    return found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "point_id"))), lambda x: x["point_id"]).alias("point_ids"))


def radius_arrays(found: DataFrame) -> DataFrame:
    """(query_id, point_ids ascending); queries without a hit have no row."""
    return found.groupBy("query_id").agg(F.sort_array(F.collect_list("point_id")).alias("point_ids"))


def counts_with_offsets(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, hits, first): each query's number of hits and how many the queries before it have."""
    hits = queries.select("query_id").join(found.groupBy("query_id").agg(F.count("*").alias("hits")).hint("merge"), "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))
    spread = written(hits.repartitionByRange("query_id").sortWithinPartitions("query_id").withColumn("part", F.spark_partition_id()), "hits")
    parts = spread.groupBy("part").agg(F.sum("hits").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    own = F.sum("hits").over(Window.partitionBy("part").orderBy("query_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("hits")
    return spread.join(F.broadcast(parts), "part").select("query_id", "hits", (own + F.col("base")).cast("bigint").alias("first"))
