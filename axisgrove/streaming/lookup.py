"""k nearest neighbours of a stream of queries in a static index: stateless, so it runs in any output mode."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from ..index import SpatialIndex
from ..operators import search

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_BYTES = 256 << 20


def knn_stream(queries: DataFrame, index: SpatialIndex, k: int) -> DataFrame:
    """(query_id, point_id, dist2) for queries (query_id, coords) of a stream. The points go to every task with the
    query plan, so the index must hold at most MOST_BYTES of coordinates and ids; larger ones raise."""
    rows, dims = index._count, index.num_dimensions
    if rows * (dims + 1) * 8 > MOST_BYTES:
        raise ValueError(f"{rows} points are too many to send to each task; search in foreachBatch instead")
    t = index.points.select("point_id", "coords").toArrow()
    kernel = search.knn_kernel(k)
    shared = queries.sparkSession.sparkContext.broadcast((t["point_id"].to_numpy(), np.array(t["coords"].combine_chunks().flatten(), dtype=float)))

    def run(batches):
        import pyarrow as pa

        ids, flat = shared.value
        right = pa.table({"point_id": ids, "coords": pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, max(1, dims), dtype=np.int32)), pa.array(flat))})
        for b in batches:
            for out in kernel(pa.Table.from_batches([b]), right).to_batches():
                yield out

    return queries.select("query_id", "coords").mapInArrow(run, search.FOUND)
