"""Connected components of a graph whose edges are spread over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest reachable node of each node in the edges (a, b) of one task: (node, smallest)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        low = np.minimum(rx, ry)
        new = root.copy()
        np.minimum.at(new, rx, low)
        np.minimum.at(new, ry, low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b): component is the smallest node that can be reached.

    Alternates two rewirings until nothing changes: each node's larger neighbours are hung on its smallest one, then its
    smaller ones are. Each round halves long chains or better and ends in the shared checkpoint folder. Minima are taken by
    pre-aggregation, and those of larger neighbours are written there too before they are joined back, so that both sides of that
    join are exchanged for it and Spark can split a node with very many neighbours over tasks (`spark.sql.adaptive.skewJoin`).
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, last = cut(e), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = cut(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
