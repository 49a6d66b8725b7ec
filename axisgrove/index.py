"""The handle of an index: points, tree and searches."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import search, tree
from .plans.planner import Plan, choose
from .sources import points as P
from .sources.storage import removed, written


def kd_node(point_id, lt_child=None, gt_child=None) -> Row:
    """A node record from its point and children; its place in a tree (split_dim, parent, brother) is not known yet."""
    return Row(point_id=point_id, lt_child=lt_child, gt_child=gt_child, split_dim=None, parent=None, brother=None)


class SpatialIndex:
    """An index of a point set. Indexes are independent of each other; what they write lies in the shared folder."""

    def __init__(self, points: DataFrame, dims: int, total: int, count: int, dedup: bool) -> None:
        self.points, self.num_dimensions, self.num_points, self._count, self.dedup = points, dims, total, count, dedup
        self._nodes: DataFrame | None = None
        self._kept: list[str] = []
        self.timings: dict[str, float] = {}
        self.last_plan: Plan | None = None

    @classmethod
    def build(cls, df: DataFrame, id_col: str, coords: str | Sequence[str], dedup: bool = True, on_invalid: str = "raise", float32: bool = False, tree_now: bool = False) -> SpatialIndex:
        """dedup keeps the lowest id of equal points; on_invalid is "raise" or "drop"; float32 rounds coordinates."""
        began = time.perf_counter()
        p = P.points(df, id_col, coords, float32=float32)
        dims = P.dimensions(p)
        p = P.validated(p, dims or None, on_invalid)
        total = None
        if dedup:
            p = P.distinct_points(p)
        kept: list[str] = []
        p = written(p, "points", kept)
        count = p.count()
        total = df.count() if on_invalid == "raise" else P.validated(P.points(df, id_col, coords), dims or None, "drop").count()
        self = cls(p, dims, total, count, dedup)
        self._kept = kept
        self.timings["points"] = time.perf_counter() - began
        if tree_now:
            _ = self.nodes
        return self

    # --- metadata and nodes

    @property
    def numPoints(self) -> int:  # noqa: N802
        return self.num_points

    @property
    def numDimensions(self) -> int:  # noqa: N802
        return self.num_dimensions

    def __repr__(self) -> str:
        return f"<SpatialIndex of {self.num_dimensions}dims and {self.num_points}points on Spark>"

    def info(self) -> DataFrame:
        """One row: num_points, num_dimensions, num_nodes."""
        spark = self.points.sparkSession
        return spark.range(1).select(F.lit(self.num_points).cast("bigint").alias("num_points"), F.lit(self.num_dimensions).cast("int").alias("num_dimensions"), F.lit(self._count).cast("bigint").alias("num_nodes"))

    def build_stats(self) -> DataFrame:
        """One row: points, equal_removed, nodes and the seconds of each phase so far."""
        _ = self.nodes
        row = [self.num_points, self.num_points - self._count, self._count, float(self.timings["points"]), float(self.timings["tree"])]
        return self.points.sparkSession.createDataFrame([row], "points bigint, equal_removed bigint, nodes bigint, points_seconds double, tree_seconds double")

    @property
    def nodes(self) -> DataFrame:
        """The node table; see operators.tree.linked."""
        if self._nodes is None:
            if not self.dedup:
                raise ValueError("a tree needs distinct points: build with dedup=True")
            began = time.perf_counter()
            d = max(1, self.num_dimensions)
            self._nodes = written(tree.linked(tree.placed(self.points, d), d), "nodes", self._kept)
            self.timings["tree"] = time.perf_counter() - began
        return self._nodes

    def compatible_nodes(self) -> DataFrame:
        """The node table with -1 for what is absent."""
        return self.nodes.select("node_id", *(F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in ("point_id", "lt_child", "gt_child", "split_dim", "parent", "brother")))

    @property
    def root(self) -> DataFrame:
        return self.nodes.where("parent is null")

    def node(self, node_id: int) -> DataFrame:
        """The node of a point; no row if there is none."""
        return self.nodes.where(F.col("node_id") == node_id)

    def materialize(self) -> SpatialIndex:
        """Makes sure that points and nodes are written; the index itself comes back."""
        _ = self.nodes
        return self

    cpu = materialize

    def verify(self) -> DataFrame:
        return tree.verified(self.nodes, max(1, self.num_dimensions))

    def render(self) -> DataFrame:
        return tree.rendered(self.nodes)

    def close(self) -> None:
        """Deletes what the index has written to the shared folder; it and the results that still read it end with that.
        Saved copies stay."""
        self._nodes = None
        removed(self.points.sparkSession, self._kept)

    # --- on disk

    def save(self, path: str) -> None:
        """Points, metadata and, where there is one (dedup=True), the tree."""
        self.points.write.mode("overwrite").parquet(f"{path}/points")
        if self.dedup:
            self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        meta = self.points.sparkSession.createDataFrame([(self.num_points, self.num_dimensions, self._count, self.dedup)], "num_points bigint, num_dimensions int, num_nodes bigint, dedup boolean")
        meta.write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SpatialIndex:
        m = spark.read.parquet(f"{path}/meta").first()
        self = cls(spark.read.parquet(f"{path}/points"), m["num_dimensions"], m["num_points"], m["num_nodes"], m["dedup"])
        self._nodes, self.timings = spark.read.parquet(f"{path}/nodes") if m["dedup"] else None, {"points": 0.0, "tree": 0.0}
        return self

    # --- searches

    def _queries(self, df: DataFrame, id_col: str, coords: str | Sequence[str], float32: bool = False) -> DataFrame:
        return P.validated(P.points(df, id_col, coords, "query_id", float32), self.num_dimensions or None)

    def search_knn(self, queries: DataFrame, k: int, id_col: str = "query_id", coords: str | Sequence[str] = "coords", strategy: str | None = None) -> DataFrame:
        """(query_id, rank, point_id, dist2): the k nearest points of each query, min(k, points) rows a query."""
        if k < 1:
            raise ValueError("k must be at least 1")
        q = self._queries(queries, id_col, coords)
        nq = queries.count()
        self.last_plan = plan = choose("knn", self._count, nq, self.num_dimensions, strategy)
        if plan.strategy == "brute":
            return search.knn_brute(q, self.points, k)
        if plan.strategy == "cells":
            return search.knn_cells(q, self.points, k, self._count)
        return search.knn_block(q, self.points, k, self._count, nq)

    def search_nearest(self, queries: DataFrame, id_col: str = "query_id", coords: str | Sequence[str] = "coords", strategy: str | None = None) -> DataFrame:
        """(query_id, point_id, dist2) of the nearest point."""
        return self.search_knn(queries, 1, id_col, coords, strategy).select("query_id", "point_id", "dist2")

    def search_radius(self, queries: DataFrame, radius: float, id_col: str = "query_id", coords: str | Sequence[str] = "coords", strategy: str | None = None) -> DataFrame:
        """(query_id, point_id, dist2) of all points strictly nearer than the radius."""
        if not radius >= 0:
            raise ValueError("radius must not be negative")
        q = self._queries(queries, id_col, coords)
        nq = queries.count()
        self.last_plan = plan = choose("radius", self._count, nq, self.num_dimensions, strategy)
        if radius == 0 or plan.strategy == "brute":
            return search.radius_brute(q, self.points, radius) if radius else search.radius_brute(q.limit(0), self.points.limit(0), 0.0)
        if plan.strategy == "grid":
            return search.radius_grid(q, self.points, radius, self.num_dimensions)
        return search.radius_block(q, self.points, radius, self._count, nq)

    def search_box(self, queries: DataFrame, cut: float, id_col: str = "query_id", coords: str | Sequence[str] = "coords", strategy: str | None = None) -> DataFrame:
        """(query_id, point_id) of all points that differ by at most cut on every axis."""
        if not cut >= 0:
            raise ValueError("cut must not be negative")
        q = self._queries(queries, id_col, coords)
        nq = queries.count()
        self.last_plan = plan = choose("box", self._count, nq, self.num_dimensions, strategy)
        if plan.strategy == "brute":
            return search.box_brute(q, self.points, cut)
        if plan.strategy == "block":
            return search.box_block(q, self.points, cut, self._count, nq)
        return search.box_grid(q, self.points, cut, self.num_dimensions)

    def locate(self, queries: DataFrame, id_col: str = "query_id", coords: str | Sequence[str] = "coords") -> DataFrame:
        """(query_id, node_id) of the leaf that each query descends to."""
        return tree.located(self._queries(queries, id_col, coords), self.nodes, max(1, self.num_dimensions))
