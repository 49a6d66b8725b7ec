"""The engine's own queries and, for each, SQL that gives the same rows.

Searches take as queries every row whose id is divisible by 100, or all rows of a table, against all points.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .functions.expressions import super_key
from .index import SpatialIndex
from .operators import search, tree
from .sources import points as P
from .sources.storage import shared_folder

KNN, RADIUS, PART_RADIUS, CUT = 5, 1.2, 3.0, 2.0
CUBE_RADIUS, EMBEDDING_CUT, NODE = 9.0, 0.35, 7
LEVELS = 20  # of the unrolled SQL: up to a million distinct parts


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _embeddings(spark: SparkSession, sf: str) -> tuple[SpatialIndex, DataFrame]:
    e = _table(spark, sf, "embeddings")
    q = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("coords"))
    return SpatialIndex.build(e, "vec_id", "embedding", dedup=False), q


def _parts(spark: SparkSession, sf: str) -> SpatialIndex:
    return SpatialIndex.build(_table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"])


def _shifted(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.array(F.col("p_size") + F.lit(0.5), F.col("p_retailprice") + F.lit(0.05)).alias("coords"))


def _own(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("coords"))


def nearest_embeddings(spark, sf):
    index, q = _embeddings(spark, sf)
    return index.search_nearest(q).select("query_id", "point_id")


def knn5_embeddings(spark, sf):
    index, q = _embeddings(spark, sf)
    return index.search_knn(q, KNN).select("query_id", F.col("rank").cast("bigint").alias("rank"), "point_id")


def radius_embeddings(spark, sf):
    index, q = _embeddings(spark, sf)
    return index.search_radius(q, RADIUS).select("query_id", "point_id")


def nearest_part_2d(spark, sf):
    return _parts(spark, sf).search_nearest(_shifted(spark, sf)).select("query_id", "point_id")


def knn_part_2d(spark, sf):
    return _parts(spark, sf).search_knn(_own(spark, sf), KNN).select("query_id", F.col("rank").cast("bigint").alias("rank"), "point_id")


def radius_part_2d(spark, sf):
    return _parts(spark, sf).search_radius(_own(spark, sf), PART_RADIUS).select("query_id", "point_id")


def box_part_2d(spark, sf):
    return _parts(spark, sf).search_box(_own(spark, sf), CUT).select("query_id", "point_id")


def radius_counts(spark, sf):
    c = _table(spark, sf, "customer")
    index = SpatialIndex.build(c, "c_custkey", ["c_nationkey", "c_acctbal"])
    q = c.select(F.col("c_custkey").alias("query_id"), F.array(F.col("c_nationkey").cast("double"), F.col("c_acctbal")).alias("coords"))
    return search.counts_with_offsets(index.search_radius(q, PART_RADIUS), q)


def dedup_part(spark, sf):
    return P.distinct_points(P.points(_table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"])).select("point_id")


def dedup_lineitem_counts(spark, sf):
    p = P.points(_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_quantity", "l_discount", "l_tax"), "id", ["l_quantity", "l_discount", "l_tax"])
    d = P.distinct_points(p)
    return d.agg(F.count("*").alias("distinct_points")).join(F.broadcast(p.agg(F.count("*").alias("points")))).select("points", "distinct_points", (F.col("points") - F.col("distinct_points")).alias("equal_removed"))


def _ranks(axis: int):
    def query(spark, sf):
        p = P.points(_table(spark, sf, "customer"), "c_custkey", ["c_nationkey", "c_acctbal"]).select("point_id", "coords", F.lit(1).cast("bigint").alias("path"))
        r = tree._ranked(p.withColumnRenamed("point_id", "node_id"), axis, 2)
        return r.select(F.col("node_id").alias("point_id"), F.col("rn").cast("bigint").alias("rank"))

    return query


def kd_nodes_part(spark, sf):
    return _parts(spark, sf).nodes.select("node_id", "lt_child", "gt_child", "split_dim", "parent", "brother", "depth")


def kd_root_part(spark, sf):
    return _parts(spark, sf).root.select("node_id", "lt_child", "gt_child", "split_dim", "depth")


def kd_verify_part(spark, sf):
    return _parts(spark, sf).verify()


def kd_locate_part(spark, sf):
    return _parts(spark, sf).locate(_shifted(spark, sf))


def kd_render_part(spark, sf):
    return _parts(spark, sf).render().select(F.col("line").cast("bigint").alias("line"), F.length(F.regexp_extract("text", "^ *", 0)).cast("bigint").alias("indent"))


def index_info(spark, sf):
    e = _table(spark, sf, "embeddings")
    return SpatialIndex.build(e, "vec_id", "embedding").info()


def knn_arrays_part(spark, sf):
    return search.neighbour_arrays(_parts(spark, sf).search_knn(_own(spark, sf), KNN)).select("query_id", F.array_join(F.transform("point_ids", lambda x: x.cast("string")), ",").alias("point_ids"))


# strategies and parts that tables of this size would not take by themselves


def _cube(spark: SparkSession, sf: str, name: str):
    return _table(spark, sf, "part").select(F.col("p_partkey").alias(name), F.array(F.col("p_size").cast("double"), F.col("p_retailprice"), (F.col("p_partkey") % 97).cast("double")).alias("coords"))


def knn_cells_part_3d(spark, sf):
    index = SpatialIndex.build(_cube(spark, sf, "point_id"), "point_id", "coords")
    return index.search_knn(_cube(spark, sf, "query_id"), KNN, strategy="cells").select("query_id", F.col("rank").cast("bigint").alias("rank"), "point_id")


def radius_grid_part_3d(spark, sf):
    index = SpatialIndex.build(_cube(spark, sf, "point_id"), "point_id", "coords")
    return index.search_radius(_cube(spark, sf, "query_id"), CUBE_RADIUS, strategy="grid").select("query_id", "point_id")


def box_block_embeddings(spark, sf):
    index, q = _embeddings(spark, sf)
    return index.search_box(q, EMBEDDING_CUT, strategy="block").select("query_id", "point_id")


def knn_float32_part(spark, sf):
    index = SpatialIndex.build(_table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"], float32=True)
    return index.search_knn(_own(spark, sf), KNN).select("query_id", F.col("rank").cast("bigint").alias("rank"), "point_id")


def radius_arrays_part(spark, sf):
    found = search.radius_arrays(_parts(spark, sf).search_radius(_own(spark, sf), PART_RADIUS))
    return found.select("query_id", F.array_join(F.transform("point_ids", lambda x: x.cast("string")), ",").alias("point_ids"))


def _levels_part(spark, sf):
    """The tree by distributed levels down to segments of 100 points."""
    points = P.distinct_points(P.points(_table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"]))
    return tree.linked(tree.placed(points, 2, subtree=100), 2)


def kd_levels_part(spark, sf):
    return _levels_part(spark, sf).select("node_id", "lt_child", "gt_child", "split_dim", "parent", "brother", "depth")


def kd_locate_subtrees_part(spark, sf):
    return tree.located(_shifted(spark, sf), _parts(spark, sf).nodes, 2, upper=4)


def kd_ancestors_part(spark, sf):
    """Pairs of a node and an ancestor, and how many of them are on the wrong side."""
    nodes = _levels_part(spark, sf)
    return nodes.agg(F.sum("depth").alias("pairs")).join(F.broadcast(tree.boxed_violations(nodes, 2).agg(F.count("*").alias("violations"))))


def kd_lines_part(spark, sf):
    return _parts(spark, sf).render()


def kd_node_part(spark, sf):
    return _parts(spark, sf).node(NODE).select("node_id", "lt_child", "gt_child", "split_dim", "parent", "brother", "depth")


def build_stats_part(spark, sf):
    return _parts(spark, sf).build_stats().select("points", "equal_removed", "nodes")


def saved_index_part(spark, sf):
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    _parts(spark, sf).materialize().save(path)
    return SpatialIndex.load(spark, path).compatible_nodes()


def two_indexes(spark, sf):
    """Indexes side by side: one keeps its answers while another is built and closed."""
    parts = _parts(spark, sf)
    other = SpatialIndex.build(_table(spark, sf, "customer"), "c_custkey", ["c_nationkey", "c_acctbal"])
    second = other.info().select(F.lit("customer").alias("name"), "num_points", "num_nodes")
    other.close()
    return parts.info().select(F.lit("part").alias("name"), "num_points", "num_nodes").unionByName(second)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "nearest_embeddings": nearest_embeddings, "knn5_embeddings": knn5_embeddings, "radius_embeddings": radius_embeddings,
        "nearest_part_2d": nearest_part_2d, "knn_part_2d": knn_part_2d, "radius_part_2d": radius_part_2d, "box_part_2d": box_part_2d,
        "radius_counts": radius_counts, "dedup_part": dedup_part, "dedup_lineitem_counts": dedup_lineitem_counts,
        "superkey_rank_axis0": _ranks(0), "superkey_rank_axis1": _ranks(1),
        "kd_nodes_part": kd_nodes_part, "kd_root_part": kd_root_part, "kd_verify_part": kd_verify_part, "kd_locate_part": kd_locate_part, "kd_render_part": kd_render_part,
        "index_info": index_info, "knn_arrays_part": knn_arrays_part,
        "knn_cells_part_3d": knn_cells_part_3d, "radius_grid_part_3d": radius_grid_part_3d, "box_block_embeddings": box_block_embeddings, "knn_float32_part": knn_float32_part,
        "radius_arrays_part": radius_arrays_part, "kd_levels_part": kd_levels_part, "kd_locate_subtrees_part": kd_locate_subtrees_part, "kd_ancestors_part": kd_ancestors_part,
        "kd_lines_part": kd_lines_part, "kd_node_part": kd_node_part, "build_stats_part": build_stats_part, "saved_index_part": saved_index_part, "two_indexes": two_indexes,
    }


# --- SQL

_EMB = """p AS (SELECT vec_id AS point_id, embedding AS e FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS f FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT query_id, point_id, list_sum(list_transform(list_zip(f, e), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d2 FROM q, p)"""
_PART = "p AS (SELECT min(p_partkey) AS point_id, p_size::DOUBLE AS x, p_retailprice AS y FROM part GROUP BY p_size, p_retailprice)"
_OWN = "q AS (SELECT p_partkey AS query_id, p_size::DOUBLE AS x, p_retailprice AS y FROM part)"
_SHIFTED = "q AS (SELECT p_partkey AS query_id, p_size + 0.5::DOUBLE AS x, p_retailprice + 0.05::DOUBLE AS y FROM part)"
_D2 = "d AS (SELECT query_id, point_id, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) AS d2 FROM q, p)"
_TOP = "SELECT query_id, {cols} FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) <= {k}"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) AS rank, point_id"


def _levels() -> str:
    """The node table level by level: lower medians in the cyclic order of the level's axis."""
    out = [_PART, "s0 AS (SELECT 1::BIGINT AS path, point_id, x, y FROM p)"]
    for k in range(LEVELS):
        order = "x, y" if k % 2 == 0 else "y, x"
        out.append(f"r{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY path) AS n FROM s{k})")
        out.append(f"s{k + 1} AS (SELECT 2 * path + (rn > (n + 1) // 2)::BIGINT AS path, point_id, x, y FROM r{k} WHERE rn <> (n + 1) // 2)")
    nodes = " UNION ALL ".join(f"SELECT path, point_id AS node_id, x, y, {k}::INTEGER AS depth FROM r{k} WHERE rn = (n + 1) // 2" for k in range(LEVELS))
    out.append(f"t AS MATERIALIZED ({nodes})")
    out.append("""nodes AS MATERIALIZED (SELECT t.path, t.node_id, t.x, t.y, l.node_id AS lt_child, g.node_id AS gt_child, (t.depth % 2)::INTEGER AS split_dim, u.node_id AS parent, CASE WHEN t.path > 1 THEN b.node_id END AS brother, t.depth
  FROM t LEFT JOIN t l ON l.path = 2 * t.path LEFT JOIN t g ON g.path = 2 * t.path + 1 LEFT JOIN t u ON t.path > 1 AND u.path = t.path // 2 LEFT JOIN t b ON t.path > 1 AND b.path = xor(t.path, 1))""")
    return ",\n".join(out)


def _locate() -> str:
    out = [_levels(), _SHIFTED, "l0 AS (SELECT query_id, q.x, q.y, node_id AS here FROM q, nodes WHERE parent IS NULL)"]
    for k in range(LEVELS):
        out.append(f"""l{k + 1} AS MATERIALIZED (SELECT query_id, l.x, l.y, CASE WHEN lt_child IS NULL AND gt_child IS NULL THEN here WHEN lt_child IS NULL THEN gt_child WHEN gt_child IS NULL THEN lt_child
  WHEN (CASE WHEN split_dim = 0 THEN l.x < n.x ELSE l.y < n.y END) THEN lt_child ELSE gt_child END AS here FROM l{k} l JOIN nodes n ON n.node_id = l.here)""")
    return f"WITH {','.join(out)} SELECT query_id, here AS node_id FROM l{LEVELS}"


_CUBE = """p AS (SELECT p_partkey AS point_id, p_size::DOUBLE AS x, p_retailprice AS y, (p_partkey % 97)::DOUBLE AS z FROM part),
q AS (SELECT point_id AS query_id, x, y, z FROM p), u AS (SELECT min(point_id) AS point_id, x, y, z FROM p GROUP BY x, y, z),
d AS (SELECT query_id, point_id, (q.x - u.x) * (q.x - u.x) + (q.y - u.y) * (q.y - u.y) + (q.z - u.z) * (q.z - u.z) AS d2 FROM q, u)"""
_SINGLE = "p AS (SELECT min(p_partkey) AS point_id, p_size::FLOAT::DOUBLE AS x, p_retailprice::FLOAT::DOUBLE AS y FROM part GROUP BY p_size::FLOAT, p_retailprice::FLOAT)"


def oracle_sql() -> dict[str, str]:
    levels = _levels()
    nodes = "SELECT node_id, lt_child, gt_child, split_dim, parent, brother, depth FROM nodes"
    return {
        "knn_cells_part_3d": f"WITH {_CUBE} " + _TOP.format(cols=_RANK, k=KNN),
        "radius_grid_part_3d": f"WITH {_CUBE} SELECT query_id, point_id FROM d WHERE d2 < {CUBE_RADIUS * CUBE_RADIUS}",
        "box_block_embeddings": f"""WITH p AS (SELECT vec_id AS point_id, embedding AS e FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS f FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, point_id FROM q, p WHERE list_max(list_transform(list_zip(f, e), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) <= {EMBEDDING_CUT}::DOUBLE""",
        "knn_float32_part": f"WITH {_SINGLE}, {_OWN}, {_D2} " + _TOP.format(cols=_RANK, k=KNN),
        "radius_arrays_part": f"WITH {_PART}, {_OWN}, {_D2} SELECT query_id, string_agg(point_id::VARCHAR, ',' ORDER BY point_id) AS point_ids FROM d WHERE d2 < {PART_RADIUS * PART_RADIUS} GROUP BY query_id",
        "kd_levels_part": f"WITH {levels} {nodes}",
        "kd_locate_subtrees_part": _locate(),
        "kd_ancestors_part": f"""WITH {levels}, a AS (SELECT n.path, n.x, n.y, n.depth, unnest(range(1, n.depth + 1)) AS k FROM nodes n), b AS (SELECT a.*, u.x AS ux, u.y AS uy, u.split_dim AS s, (a.path >> (k - 1)) % 2 = 0 AS l FROM a JOIN nodes u ON u.path = a.path >> a.k)
SELECT count(*) AS pairs, count(*) FILTER (NOT CASE WHEN l THEN CASE WHEN s = 0 THEN (x, y) < (ux, uy) ELSE (y, x) < (uy, ux) END ELSE CASE WHEN s = 0 THEN (x, y) > (ux, uy) ELSE (y, x) > (uy, ux) END END) AS violations FROM b""",
        "kd_lines_part": f"WITH {levels} SELECT row_number() OVER (ORDER BY (path * 2 + 1) * (1::BIGINT << (61 - depth)) DESC) AS line, repeat(' ', 7 * depth) || '(' || x::VARCHAR || ', ' || y::VARCHAR || ')' AS text FROM nodes",
        "kd_node_part": f"WITH {levels} {nodes} WHERE node_id = {NODE}",
        "build_stats_part": f"WITH {_PART}, a AS (SELECT count(*) AS points FROM part), b AS (SELECT count(*) AS nodes FROM p) SELECT points, points - nodes AS equal_removed, nodes FROM a, b",
        "saved_index_part": f"WITH {levels} SELECT node_id, node_id AS point_id, coalesce(lt_child, -1) AS lt_child, coalesce(gt_child, -1) AS gt_child, split_dim, coalesce(parent, -1) AS parent, coalesce(brother, -1) AS brother FROM nodes",
        "two_indexes": "SELECT 'part' AS name, count(*) AS num_points, count(DISTINCT (p_size, p_retailprice)) AS num_nodes FROM part UNION ALL SELECT 'customer', count(*), count(DISTINCT (c_nationkey, c_acctbal)) FROM customer",
        "nearest_embeddings": f"WITH {_EMB} " + _TOP.format(cols="point_id", k=1),
        "knn5_embeddings": f"WITH {_EMB} " + _TOP.format(cols=_RANK, k=KNN),
        "radius_embeddings": f"WITH {_EMB} SELECT query_id, point_id FROM d WHERE d2 < {RADIUS}::DOUBLE * {RADIUS}::DOUBLE",
        "nearest_part_2d": f"WITH {_PART}, {_SHIFTED}, {_D2} " + _TOP.format(cols="point_id", k=1),
        "knn_part_2d": f"WITH {_PART}, {_OWN}, {_D2} " + _TOP.format(cols=_RANK, k=KNN),
        "radius_part_2d": f"WITH {_PART}, {_OWN}, {_D2} SELECT query_id, point_id FROM d WHERE d2 < {PART_RADIUS * PART_RADIUS}",
        "box_part_2d": f"WITH {_PART}, {_OWN} SELECT query_id, point_id FROM q, p WHERE abs(q.x - p.x) <= {CUT} AND abs(q.y - p.y) <= {CUT}",
        "radius_counts": f"""WITH p AS (SELECT min(c_custkey) AS point_id, c_nationkey::DOUBLE AS x, c_acctbal AS y FROM customer GROUP BY c_nationkey, c_acctbal),
q AS (SELECT c_custkey AS query_id, c_nationkey::DOUBLE AS x, c_acctbal AS y FROM customer), {_D2},
h AS (SELECT query_id, count(*) AS hits FROM d WHERE d2 < {PART_RADIUS * PART_RADIUS} GROUP BY query_id), a AS (SELECT query_id, coalesce(hits, 0)::BIGINT AS hits FROM q LEFT JOIN h USING (query_id))
SELECT query_id, hits, (sum(hits) OVER (ORDER BY query_id) - hits)::BIGINT AS first FROM a""",
        "dedup_part": f"WITH {_PART} SELECT point_id FROM p",
        "dedup_lineitem_counts": "WITH a AS (SELECT count(*) AS points FROM lineitem), b AS (SELECT count(*) AS distinct_points FROM (SELECT DISTINCT l_quantity, l_discount, l_tax FROM lineitem)) SELECT points, distinct_points, points - distinct_points AS equal_removed FROM a, b",
        "superkey_rank_axis0": "SELECT c_custkey AS point_id, row_number() OVER (ORDER BY c_nationkey, c_acctbal, c_custkey) AS rank FROM customer",
        "superkey_rank_axis1": "SELECT c_custkey AS point_id, row_number() OVER (ORDER BY c_acctbal, c_nationkey, c_custkey) AS rank FROM customer",
        "kd_nodes_part": f"WITH {levels} SELECT node_id, lt_child, gt_child, split_dim, parent, brother, depth FROM nodes",
        "kd_root_part": f"WITH {levels} SELECT node_id, lt_child, gt_child, split_dim, depth FROM nodes WHERE parent IS NULL",
        "kd_verify_part": f"""WITH {levels} SELECT count(*) AS nodes, sum((parent IS NULL)::BIGINT)::BIGINT AS roots, max(depth)::INTEGER AS max_depth,
(SELECT count(*) FROM nodes c JOIN nodes u ON u.node_id = c.parent WHERE NOT CASE WHEN u.split_dim = 0 THEN CASE WHEN c.node_id = u.lt_child THEN (c.x, c.y) < (u.x, u.y) ELSE (c.x, c.y) > (u.x, u.y) END
  ELSE CASE WHEN c.node_id = u.lt_child THEN (c.y, c.x) < (u.y, u.x) ELSE (c.y, c.x) > (u.y, u.x) END END)::BIGINT AS violations FROM nodes""",
        "kd_locate_part": _locate(),
        "kd_render_part": f"WITH {levels} SELECT row_number() OVER (ORDER BY (path * 2 + 1) * (1::BIGINT << (61 - depth)) DESC) AS line, (7 * depth)::BIGINT AS indent FROM nodes",
        "index_info": "SELECT count(*) AS num_points, max(len(embedding))::INTEGER AS num_dimensions, count(DISTINCT embedding) AS num_nodes FROM embeddings",
        "knn_arrays_part": f"WITH {_PART}, {_OWN}, {_D2}, k AS (" + _TOP.format(cols=_RANK, k=KNN) + ") SELECT query_id, string_agg(point_id::VARCHAR, ',' ORDER BY rank) AS point_ids FROM k GROUP BY query_id",
    }
