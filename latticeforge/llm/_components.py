"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node, combined on the map side and written before it is joined: adaptive execution splits
the hot keys of a join only if no aggregate stands between it and the shuffle. A node's whole neighbourhood is never
gathered. Callers may let links that are few be settled on the driver instead, where each step would cost several jobs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), rising, and the smallest node that each reaches."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def connected_components(links: DataFrame, max_rounds: int = 60, few: int = 0) -> DataFrame:
    """Rows (node, root) of every node that has a link; root is the smallest node it reaches.

    ``links`` has two long columns, one row for a link in either direction; repeated rows, self-links and
    nulls are ignored. No links give no rows. ``few`` links or less are settled on the driver, more by rounds of joins.
    """
    a, b = links.columns
    links = links.dropna(subset=[a, b])
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = cut(edges.where("a > b").distinct())
    before = _state(edges)
    if before[0] <= few:
        found = edges.toArrow()
        node, root = local_components(*(found.column(x).to_numpy() for x in ("a", "b")))
        return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64())}))
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        stars = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(cut(_least(both)), "u")
        large = stars.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = down.join(cut(_least(down)), "u")
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select("u", "m"))
        edges = cut(small.where("a > b").distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
