"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import written

#: Most edges that one task takes: two longs each.
MOST_LOCAL = 1 << 21


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the least node of each one's component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            return nodes, nodes[root]
        # Roots hook to smaller roots across edges, then paths are halved until they are flat.
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(flat := root[root], root):
            root = flat


def _one_task(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pairs = [frame[["u", "v"]].to_numpy(np.int64) for frame in rows]
    if pairs:
        pair = np.concatenate(pairs)
        nodes, root = local_roots(pair[:, 0], pair[:, 1])
        yield pd.DataFrame({"node": nodes, "root": root})


def components(edges: DataFrame, a: str = "a", b: str = "b", most_local: int = MOST_LOCAL) -> DataFrame:
    """node, root: the smallest node reachable, for every node that has an edge. Nodes are longs.

    At most most_local edges, counted first, are solved in one task of bounded memory. More are
    solved in rounds of joins: each takes the least root among a node's neighbours and then
    that root's own root, so paths halve, and writes the roots to the shared folder. No edge
    reaches the driver either way.

    Loops and repeated edges are allowed; rows with a null end are left out; an empty table
    gives no rows.
    """
    pair = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    pair = written(pair, "edges")
    if pair.count() <= most_local:
        return written(pair.coalesce(1).mapInPandas(_one_task, "node long, root long"), "roots")
    both = written(pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    roots = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("near"))
        hooked = roots.join(near.withColumnRenamed("u", "node"), "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        step = written(hooked.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("higher", "root")).alias("root")), "roots")
        roots = step.select("node", "root")
        if step.filter("old <> root").isEmpty():
            return roots
