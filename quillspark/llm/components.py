"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut

#: Edges that a task joins up by itself before anything is shuffled.
LOCAL_EDGES = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node of these edges that isn't the smallest of its component: the node, and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


def contracted(edges: DataFrame) -> DataFrame:
    """u > v: edges with the same components, at most as many, and stars where a task saw all of a component."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= LOCAL_EDGES:
                yield star_frame(held)
                held = []
        if held:
            yield star_frame(held)

    def star_frame(held: list[pd.DataFrame]) -> pd.DataFrame:
        u, v = stars(*(np.concatenate([f[c].to_numpy(dtype=np.int64) for f in held]) for c in ("a", "b")))
        return pd.DataFrame({"u": u, "v": v})

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInPandas(run, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges(a, b) that has a neighbour. Nodes are longs.

    Each task first joins up its own edges. Then, in turn, a node's larger neighbours and its smaller ones are hung on its smallest neighbour; all of
    it is aggregates and joins. Only nodes that have a smaller neighbour are looked up, in a plain table, so that the many rows
    of a component's smallest node can be split. It ends when all is stars; the steps grow with the logarithm of a component, and each is checkpointed.
    """
    now = cut(contracted(edges))
    while True:
        lower = cut(now.groupBy("u").agg(F.min("v").alias("m")))
        up = lower.select(F.col("u").alias("v"), "m")
        if lower.count() == now.count() and now.join(up, "v", "left_semi").isEmpty():
            break
        large = cut(now.join(up, "v", "left").select("u", F.coalesce("m", "v").alias("v")).unionByName(lower.withColumnRenamed("m", "v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
