"""Closures over parent pointers by pointer jumping: each round doubles the distance a node has looked along its chain, so a chain
of n nodes takes log2 n joins of equal size, and it ends soon after the longest chain has; cycles end because a chain that hasn't ended after as many rounds as all
nodes could make up is one."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut

CUT_EVERY = 4


def along_chain(nodes: DataFrame) -> DataFrame:
    """node, value, steps, root: the first non-null value along the chain of parents, the number of steps to it, and the chain's last node. nodes: node,
    parent, value. In a cycle the value is found if any node has one, and root is null."""
    now = nodes.select("node", F.col("parent").alias("jump"), "value", F.when(F.col("value").isNotNull(), F.lit(0)).cast("long").alias("steps"), F.lit(1).cast("long").alias("far"), F.col("node").alias("root"))
    rounds = max(1, math.ceil(math.log2(max(2, nodes.count()))) + 1)
    for k in range(rounds):
        next_ = now.select(F.col("node").alias("jump"), F.col("jump").alias("n_jump"), F.col("value").alias("n_value"), F.col("steps").alias("n_steps"), F.col("far").alias("n_far"), F.col("root").alias("n_root"))
        moved = now.join(next_, "jump", "left")
        met = F.col("n_far").isNotNull()
        now = moved.select(
            "node",
            F.when(met, F.col("n_jump")).otherwise(F.lit(None)).alias("jump"),
            F.coalesce("value", "n_value").alias("value"),
            F.coalesce("steps", F.col("far") + F.col("n_steps")).alias("steps"),
            F.when(met, F.col("far") + F.col("n_far")).otherwise(F.col("far")).alias("far"),
            F.when(met, F.col("n_root")).otherwise(F.col("root")).alias("root"),
        )
        if k % CUT_EVERY == CUT_EVERY - 1:
            now = cut(now)
            if now.where("jump is not null").isEmpty():
                break
    return now.select("node", "value", "steps", F.when(F.col("jump").isNull(), F.col("root")).alias("root"))


def without_same_below(nodes: DataFrame, role: str = "role") -> DataFrame:
    """Nodes that have no descendant of their own role. Each node looks for its nearest ancestor of the same role; whoever is found goes. Nodes: node,
    parent, role; trees of any depth, by walking up level after level while someone is still looking."""
    found = nodes.where(F.lit(False)).select(F.col("node").alias("hit"))
    looking = nodes.where("parent is not null").select(F.col(role).alias("want"), F.col("parent").alias("at")).distinct()
    up = nodes.select(F.col("node").alias("at"), F.col("parent").alias("above"), F.col(role).alias("has"))
    seen = looking
    while True:
        at = looking.join(up, "at")
        found = found.union(at.where("has = want").select("at")).distinct()
        looking = at.where("has <> want and above is not null").select("want", F.col("above").alias("at")).distinct()
        looking = cut(looking.join(seen, ["want", "at"], "left_anti"))
        found = cut(found)
        if looking.isEmpty():
            return nodes.join(found, nodes["node"] == found["hit"], "left_anti")
        seen = cut(seen.union(looking))
