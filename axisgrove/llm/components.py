"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_join

#: A task gets so many edges at least.
EDGES = 50_000
#: Below so many edges one task could hold them all, and no node is treated as hot.
SALTED = 1_000_000


def _linked(edges: DataFrame, both: bool, scratch: Scratch | None = None, name: str = "") -> DataFrame:
    """(u, v, m): each node's neighbours (smaller ones only unless both) and the least of them and itself."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if both:
        e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    if scratch is None:
        return e.join(least.select("u", "m"), "u").select("u", "v", "m")
    least = scratch.keep(least, f"least-{name}")
    return salted_join(scratch, name, e, least.select("u", "m"), "u", counts=least.select("u", "n"), rows=EDGES).select("u", "v", "m")


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of every node of edges (u, v), two columns of one orderable type; component is the least
    node that can be reached. Each round writes its edges to the shared folder, so plans stay short.
    Rounds go on until the edges stop changing; if that takes more than the given number, it raises. A node with very many
    edges is dealt to several tasks.

    Defined results: an edge with a null end, or from a node to itself, links nothing; repeated edges count once; a node
    without any other edge has no row; no edges give no rows; other columns of edges are not read."""
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.keep(edges.select("u", "v").where("u <> v").distinct(), "e0")
    # the number of edges, which rounds hardly raise, decides how many tasks are worth starting
    many = e.count()
    tasks = max(1, min(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + many // EDGES))
    hot = scratch if many > SALTED else None
    before = None
    for k in itertools.count(1):
        if rounds is not None and k > rounds:
            raise RuntimeError(f"the edges still change after {rounds} rounds")
        large = _linked(e, True, hot, f"large{k}").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)
        small = _linked(large, False, hot, f"small{k}").coalesce(tasks)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = scratch.keep(small.where("u <> v").distinct().coalesce(tasks), f"e{k}")
        # a star forest has one edge for each node that is not a centre, and no centre on both sides
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")).first()
        scratch.drop(f"e{k - 1}", *(f"{t}-{size}{k}" for t in ("least", "hot") for size in ("large", "small")))
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct().coalesce(tasks)
