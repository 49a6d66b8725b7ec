"""Trees and searches against brute force, on lattices (ties), Gaussians and duplicates."""

from __future__ import annotations

import numpy as np
import pytest
from axisgrove.functions import expressions as X
from axisgrove.index import SpatialIndex
from axisgrove.operators import search, tree
from axisgrove.plans.planner import choose
from axisgrove.sources import points as P
from pyspark.sql import functions as F


def frame(spark, x, name="point_id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, coords array<double>")


def sets():
    rng = np.random.default_rng(7)
    return {"lattice": rng.integers(0, 6, (260, 3)).astype(float), "gauss": rng.normal(size=(300, 2)), "line": rng.integers(0, 40, (90, 1)).astype(float), "high": rng.normal(size=(120, 40))}


def brute(x, q):
    """Distinct points by lowest id, and squared distances summed in axis order."""
    first = {}
    for i, r in enumerate(map(tuple, x)):
        first.setdefault(r, i)
    ids = np.array(sorted(first.values()))
    d2 = np.zeros((len(q), len(ids)))
    for j in range(x.shape[1]):
        d2 += (q[:, j, None] - x[ids][:, j]) ** 2
    return ids, d2


def model_tree(points):
    """id -> path, by recursion on lower medians in the cyclic order."""
    out = {}

    def place(ids, path, level):
        if ids:
            d = len(points[ids[0]])
            ids = sorted(ids, key=lambda i: points[i][level % d :] + points[i][: level % d])
            m = (len(ids) - 1) // 2
            out[ids[m]] = path
            place(ids[:m], 2 * path, level + 1)
            place(ids[m + 1 :], 2 * path + 1, level + 1)

    place(list(points), 1, 0)
    return out


@pytest.mark.parametrize("name", ["lattice", "gauss", "line", "high"])
def test_searches(spark, name):
    x = sets()[name]
    q = np.concatenate([x[:20], x[20:40] + 0.25])
    index, qs = SpatialIndex.build(frame(spark, x), "point_id", "coords"), frame(spark, q, "query_id")
    ids, d2 = brute(x, q)
    k = 4
    order = [np.lexsort((ids, row))[:k] for row in d2]
    want = {(i, r + 1, int(ids[j])) for i, o in enumerate(order) for r, j in enumerate(o)}
    for s in ("brute", "block"):
        assert {tuple(r)[:3] for r in index.search_knn(qs, k, strategy=s).collect()} == want
    cells = search.knn_cells(qs, index.points, k, index._count, cell_points=15)
    assert {tuple(r)[:3] for r in cells.collect()} == want
    assert {tuple(r)[:2] for r in index.search_nearest(qs).collect()} == {(i, p) for i, r, p in want if r == 1}
    radius = 1.0 if name != "high" else 8.0
    inside = {(i, int(ids[j])) for i, j in zip(*np.nonzero(d2 < radius * radius))}
    for s in ("brute", "block") + (("grid",) if x.shape[1] < 4 else ()):
        assert {tuple(r)[:2] for r in index.search_radius(qs, radius, strategy=s).collect()} == inside
    if x.shape[1] < 4:
        box = {(i, int(p)) for i in range(len(q)) for p in ids if (np.abs(q[i] - x[p]) <= 1.0).all()}
        for s in ("brute", "grid"):
            assert {tuple(r) for r in index.search_box(qs, 1.0, strategy=s).collect()} == box


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100])
def test_tree_is_the_model(spark, n):
    x = np.random.default_rng(n).integers(0, 9, (n, 2)).astype(float)
    index = SpatialIndex.build(frame(spark, x), "point_id", "coords")
    first = {}
    for i, r in enumerate(map(tuple, x)):
        first.setdefault(r, i)
    want = model_tree({i: r for r, i in first.items()})
    assert {r.node_id: r.path for r in index.nodes.collect()} == want
    v = index.verify().first()
    assert (v.nodes, v.violations, v.roots) == (len(want), 0, int(bool(want)))
    assert v.max_depth == (len(want).bit_length() - 1 if want else -1)
    assert tree.boxed_violations(index.nodes, 2).count() == 0
    by_path = {p: i for i, p in want.items()}
    for r in index.nodes.collect():
        assert (r.lt_child, r.gt_child) == (by_path.get(2 * r.path), by_path.get(2 * r.path + 1))
        assert (r.parent, r.brother) == ((by_path[r.path // 2], by_path.get(r.path ^ 1)) if r.path > 1 else (None, None))
    assert index.search_knn(frame(spark, x[:1], "query_id"), 500).count() == (len(want) if n else 0)


def test_distributed_levels_build_the_same_tree(spark):
    x = np.random.default_rng(3).normal(size=(400, 2))
    p = SpatialIndex.build(frame(spark, x), "point_id", "coords").points
    rows = lambda d: sorted(tuple(r) for r in d.select("path", "node_id").collect())
    assert rows(tree.placed(p, 2, subtree=30)) == rows(tree.placed(p, 2))


def test_located_is_a_descent(spark):
    x = sets()["lattice"]
    index = SpatialIndex.build(frame(spark, x), "point_id", "coords")
    nodes = {r.node_id: r for r in index.nodes.collect()}
    root = index.root.first().node_id
    q = x[:30] + 0.5

    def descend(c):
        at = root
        while True:
            n = nodes[at]
            if n.lt_child is None and n.gt_child is None:
                return at
            if n.lt_child is None or n.gt_child is None:
                at = n.gt_child if n.lt_child is None else n.lt_child
            else:
                at = n.lt_child if c[n.split_dim] < n.coords[n.split_dim] else n.gt_child

    assert {tuple(r) for r in index.locate(frame(spark, q, "query_id")).collect()} == {(i, descend(c)) for i, c in enumerate(q)}


def test_metadata_nodes_and_disk(spark, tmp_path):
    x = np.array([[0.0, 0], [1, 1], [0, 0], [2, 2]])
    index = SpatialIndex.build(frame(spark, x), "point_id", "coords").cpu()
    assert (index.numPoints, index.numDimensions) == (4, 2) and "2dims" in repr(index)
    s = index.build_stats().first()
    assert (s.points, s.equal_removed, s.nodes) == (4, 1, 3)
    assert index.node(1).count() == 1 and index.node(2).count() == 0 and index.root.first().node_id == 1
    assert index.compatible_nodes().where("lt_child = -1").count() == 2
    text = [r.text for r in index.render().orderBy("line").collect()]
    assert [len(t) - len(t.lstrip()) for t in text] == [7, 0, 7]
    index.save(str(tmp_path / "i"))
    again = SpatialIndex.load(spark, str(tmp_path / "i"))
    q = frame(spark, x, "query_id")
    assert sorted(again.search_nearest(q).collect()) == sorted(index.search_nearest(q).collect())
    other = SpatialIndex.build(frame(spark, x + 1), "point_id", "coords")
    assert sorted(r.point_id for r in other.search_nearest(q).collect()) != sorted(r.point_id for r in index.search_nearest(q).collect())


def test_refusals(spark):
    good = frame(spark, [[0.0, 1.0]])
    index = SpatialIndex.build(good, "point_id", "coords")
    with pytest.raises(ValueError):
        index.search_knn(frame(spark, [[0.0, 1.0]], "query_id"), 0)
    with pytest.raises(ValueError):
        index.search_radius(frame(spark, [[0.0, 1.0]], "query_id"), -1)
    with pytest.raises(Exception, match="mismatch"):
        index.search_nearest(frame(spark, [[0.0]], "query_id")).collect()
    bad = spark.createDataFrame([(0, [float("nan"), 1.0]), (1, [1.0, 1.0]), (2, None)], "point_id long, coords array<double>")
    with pytest.raises(Exception, match="NaN"):
        SpatialIndex.build(bad, "point_id", "coords")
    assert SpatialIndex.build(bad, "point_id", "coords", on_invalid="drop").points.count() == 1
    with pytest.raises(ValueError):
        choose("knn", 1, 1, 2, "grid")


def test_expressions(spark):
    d = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<double>, b array<double>")
    r = d.select(
        X.squared_distance(F.col("a"), F.col("b")).alias("x"),
        X.squared_distance_columns([F.col("a")[0], F.col("a")[1]], [F.col("b")[0], F.col("b")[1]]).alias("y"),
        X.plane_distance(F.col("a"), F.col("b"), 1).alias("p"),
        X.box_distance([F.lit(0.0)], [F.lit(2.0)], [F.lit(3.0)]).alias("box"),
        X.within_ball(F.lit(25.0), 5.0).alias("open"),
        X.within_box(F.col("a"), F.col("b"), 4.0).alias("closed"),
    ).first()
    assert tuple(r) == (25.0, 25.0, 16.0, 4.0, False, True)
    zero = spark.createDataFrame([(5, [0.0]), (3, [-0.0])], "point_id long, coords array<double>")
    assert [r.point_id for r in P.distinct_points(zero).collect()] == [3]


def test_views(spark):
    x = sets()["gauss"]
    index, q = SpatialIndex.build(frame(spark, x), "point_id", "coords"), frame(spark, x[:12], "query_id")
    found = index.search_radius(q, 0.4)
    arrays = {r.query_id: r.point_ids for r in search.radius_arrays(found).collect()}
    at = 0
    for r in search.counts_with_offsets(found, q).orderBy("query_id").collect():
        assert (r.hits, r.first) == (len(arrays[r.query_id]), at)
        at += r.hits
    assert all(len(r.point_ids) == 3 for r in search.neighbour_arrays(index.search_knn(q, 3)).collect())


def test_planner():
    assert choose("knn", 1000, 100, 3).strategy == "brute"
    assert choose("knn", 10**7, 10**6, 3).strategy == "cells"
    assert choose("knn", 10**7, 10**6, 64).strategy == "block"
    assert choose("radius", 10**7, 10**6, 3).strategy == "grid"
    assert choose("box", 10**7, 10**6, 3).strategy == "grid"
    # 3^9 cells a query would be far more than the blocks are
    assert choose("box", 10**7, 10**6, 9).strategy == "block"


def test_stream(spark, tmp_path):
    from axisgrove.streaming.lookup import knn_stream

    x = sets()["gauss"]
    index = SpatialIndex.build(frame(spark, x), "point_id", "coords")
    q = frame(spark, x[:15] + 0.1, "query_id")
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    run = knn_stream(stream, index, 3).writeStream.format("memory").queryName("near").start()
    run.processAllAvailable()
    run.stop()
    got = {(r.query_id, r.point_id) for r in spark.table("near").collect()}
    assert got == {(r.query_id, r.point_id) for r in index.search_knn(q, 3).collect()}


def test_locate_in_two_passes(spark):
    """Subtrees below a few levels, queries beside and on the planes, against a plain descent."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (400, 3)).astype(float)
    q = np.concatenate([x[:150], rng.integers(0, 9, (150, 3)) + 0.5])
    index = SpatialIndex.build(frame(spark, x), "point_id", "coords")
    rows = {r.node_id: r for r in index.nodes.collect()}

    def leaf(p):
        at = next(r for r in rows.values() if r.parent is None)
        while at.lt_child is not None or at.gt_child is not None:
            both = at.lt_child is not None and at.gt_child is not None
            to = (at.lt_child if p[at.split_dim] < at.coords[at.split_dim] else at.gt_child) if both else at.lt_child if at.lt_child is not None else at.gt_child
            at = rows[to]
        return at.node_id

    want = {i: leaf(p) for i, p in enumerate(q)}
    qs = frame(spark, q, "query_id")
    for upper in (1, 3, 20):
        assert {r.query_id: r.node_id for r in tree.located(qs, index.nodes, 3, upper).collect()} == want
    assert tree.located(qs, index.nodes.limit(0), 3).collect() == [] and tree.located(qs.limit(0), index.nodes, 3, 2).collect() == []


def test_save_without_a_tree_and_close(spark, tmp_path):
    import os

    x = np.random.default_rng(2).normal(size=(50, 12))
    index = SpatialIndex.build(frame(spark, x), "point_id", "coords", dedup=False)
    index.save(f"file://{tmp_path}/i")
    again = SpatialIndex.load(spark, f"file://{tmp_path}/i")
    assert not again.dedup and again.search_nearest(frame(spark, x[:5], "query_id")).count() == 5
    files = [p.split("file:")[1].replace("///", "/") for p in index._kept]
    assert files and all(map(os.path.exists, files))
    index.close()
    assert not any(map(os.path.exists, files)) and again.points.count() == 50


def test_box_in_many_axes(spark):
    x = np.random.default_rng(3).normal(size=(200, 9))
    index, qs = SpatialIndex.build(frame(spark, x), "point_id", "coords"), frame(spark, x[:40] + 0.1, "query_id")
    want = {(i, j) for i in range(40) for j in range(200) if (np.abs(x[i] + 0.1 - x[j]) <= 1.4).all()}
    for strategy in ("block", "brute"):
        assert {(r.query_id, r.point_id) for r in index.search_box(qs, 1.4, strategy=strategy).collect()} == want and len(want) > 40


def test_kd_node():
    from axisgrove.index import kd_node

    n = kd_node(3, 1)
    assert (n.point_id, n.lt_child, n.gt_child, n.parent) == (3, 1, None, None)


@pytest.fixture
def small_broadcasts(spark):
    """Spark's own threshold for broadcasts, which is of compressed files, and an error where more than 1.5 MB are sent."""
    ours = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.maxBroadcastTableSize": "1536k"}
    before = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_radius_counts_send_no_points_through_the_driver(spark, tmp_path, small_broadcasts):
    from axisgrove import queries as own
    from checks import same

    spark.range(20_000).selectExpr("id AS c_custkey", "cast(id % 25 AS int) AS c_nationkey", "(id * 7919 % 100003) / 16D AS c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/t")
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "customer.parquet")
    same(own.queries()["radius_counts"](spark, str(tmp_path)), own.oracle_sql()["radius_counts"], str(tmp_path))


def test_radius_grid_in_three_axes_sends_no_points_through_the_driver(spark, tmp_path, small_broadcasts):
    from axisgrove import queries as own
    from checks import same

    spark.range(20_000).selectExpr("id AS p_partkey", "cast(1 + id % 50 AS int) AS p_size", "(id * 7919 % 100003) / 16D AS p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/t")
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "part.parquet")
    same(own.queries()["radius_grid_part_3d"](spark, str(tmp_path)), own.oracle_sql()["radius_grid_part_3d"], str(tmp_path))


def test_grids_compare_pairs_in_generated_code(spark):
    """Functions over arrays are evaluated pair by pair outside of it: at ten times sf0.1, 216 million of 1.7 billion pairs took over 3 minutes."""
    x = sets()["lattice"]
    index, qs = SpatialIndex.build(frame(spark, x), "point_id", "coords"), frame(spark, x[:20] - 3.5, "query_id")
    for found in (index.search_radius(qs, 1.5, strategy="grid"), index.search_box(qs, 1.5, strategy="grid")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner" in plan and "lambda" not in plan.split("Join Inner")[1].split("\n")[0]
    ids, d2 = brute(x, x[:20] - 3.5)
    assert {tuple(r)[:2] for r in index.search_radius(qs, 1.5, strategy="grid").collect()} == {(i, int(ids[j])) for i, j in zip(*np.nonzero(d2 < 2.25))}
