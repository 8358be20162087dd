"""Connected components of an edge table, without a graph on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the edges (a, b) with the smallest id that these edges reach, itself left out."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        if (root[x] == root[y]).all():
            break
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root != root[root]).any():
            root = root[root]
    own = root != np.arange(len(ids))
    return ids[own], ids[root[own]]


def _contract(batches):
    """Replace a task's edges by stars, a bounded block at a time."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy() for k in (0, 1))
        if len(a):
            v, r = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(r, pa.int64())], names=["v", "r"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs → ``(v, component)`` for every vertex that has an edge.

    Alternating large stars and small stars (Kiveris et al. 2014): each round
    hangs neighbours on the smallest vertex in reach, so the number of rounds
    grows with the logarithm of the longest chain. A hub's edges are only
    counted and joined, never gathered in one row, and the minimum they are joined
    with is stored first, so that Spark broadcasts it by its true size or splits
    the hub's partition. Null ends are dropped; no edges give no rows.
    """
    stars = "v long, r long"
    now = mapped(edges.where("a <> b").select("a", "b"), _contract, stars)
    now = cut(now.distinct())
    while True:
        both = now.select("v", "r").union(now.select(F.col("r").alias("v"), F.col("v").alias("r")))
        least = stored(both.groupBy("v").agg(F.min("r").alias("m")).select("v", F.least("v", "m").alias("m")), "least")
        large = both.where("r > v").join(least, "v").select(F.col("r").alias("v"), F.col("m").alias("r")).distinct()
        # a vertex has few smaller neighbours, one for each task that met it
        small_least = large.groupBy("v").agg(F.min("r").alias("m"))
        small = large.join(small_least, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("r")), F.struct(F.col("r").alias("v"), F.col("m").alias("r")))).alias("e"))
        then = cut(small.select("e.v", "e.r").where("v <> r").distinct())
        settled = then.groupBy("v").count().where("count > 1").isEmpty() and then.select("r").distinct().join(then.select(F.col("v").alias("r")), "r", "left_semi").isEmpty()
        if settled:
            break
        now = then
    return then.select("v", F.col("r").alias("component")).union(then.select(F.col("r").alias("v"), F.col("r").alias("component")).distinct())
