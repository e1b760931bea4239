"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def _forest(edges: DataFrame) -> DataFrame:
    """node, root: every node hangs below its smallest smaller neighbour; hung to the top by doubling."""
    up = settle(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "forest")
    while True:
        of = up.select(F.col("node").alias("at"), F.col("root").alias("next"))
        new = settle(up.join(of, up["root"] == of["at"], "left")
                     .select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forest")
        moved = new.where("moved").limit(1).count()
        up = new.select("node", "root")
        if not moved:
            return up


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) from edges a, b of bigint.

    Every round hangs each node below its smallest neighbour, contracts the trees to their roots and
    goes on with the edges between roots, of which at most half as many nodes are left. Rounds are
    written to the shared folder. Edges with a null end are left out; repeated edges and loops are
    fine (a node with loops only is its own component).
    """
    ends = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    level = settle(ends.distinct(), "edges")
    nodes = level.select(F.col("a").alias("node")).unionByName(level.select(F.col("b").alias("node"))).distinct()
    labels, level = nodes.select("node", F.col("node").alias("label")), level.where("a > b")
    while level.limit(1).count():
        up = _forest(level)
        below = up.select(F.col("node").alias("at"), F.col("root").alias("top"))
        labels = settle(labels.join(below, labels["label"] == below["at"], "left")
                        .select("node", F.coalesce("top", "label").alias("label")), "labels")
        first = level.join(up, level["a"] == up["node"]).select(F.col("root").alias("x"), "b").distinct()
        second = first.join(up, first["b"] == up["node"], "left").select("x", F.coalesce("root", "b").alias("y"))
        level = settle(second.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    return labels
