"""Connected components by a frontier that grows from many seeds at once.

A node whose hash is below all its neighbours' is a seed, so every component has one. All seeds expand together, one
layer of neighbours a round; a node takes the least label that reaches it first. Where two labels meet across an edge
they collide; the collisions form a graph between seeds, at most half as large, that is solved likewise. Random hashes
keep the layers few, whatever the components' diameter. Labels stay in tables throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.session import cut


def frontier_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``(node, label)`` for each node of an edge; the label is a node of its component.

    Null ends and loops are left out, repeated edges count once, an empty table gives an empty table. Nodes are longs.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null and u != v")
    return _solve(cut(e.union(e.select("v", "u")).distinct()))


def _solve(adjacent: DataFrame) -> DataFrame:
    spark = adjacent.sparkSession
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    nodes = adjacent.groupBy("u").agg(F.min(rank("v")).alias("least"))
    labels = cut(nodes.select(F.col("u").alias("node"), F.when(rank("u") < F.col("least"), F.col("u")).alias("label")))
    frontier, rest = labels.where("label is not null"), labels.where("label is null").select("node")
    parts = [frontier]
    while not rest.isEmpty():
        reached = frontier.join(adjacent, F.col("node") == F.col("u")).select(F.col("v").alias("node"), "label").join(rest, "node", "left_semi").groupBy("node").agg(F.min("label").alias("label"))
        frontier = cut(reached)
        parts.append(frontier)
        rest = cut(rest.join(frontier, "node", "left_anti"))
    labels = parts[0]
    for p in parts[1:]:
        labels = labels.union(p)
    lu, lv = (labels.select(F.col("node").alias(x), F.col("label").alias("l" + x)) for x in "uv")
    meet = cut(adjacent.where("u < v").join(lu, "u").join(lv, "v").where("lu != lv").select(F.col("lu").alias("u"), F.col("lv").alias("v")).distinct())
    if meet.isEmpty():
        return labels
    above = _solve(cut(meet.union(meet.select("v", "u")).distinct())).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return cut(labels.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
