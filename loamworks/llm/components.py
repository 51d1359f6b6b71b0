"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.session import Workspace


def components(edges: DataFrame, work: Workspace, name: str, start: DataFrame | None = None) -> DataFrame:
    """(node, label) for each node of edges (a, b): the smallest node that it reaches.

    Each round takes the smallest label among neighbours and then the label's own label, until nothing changes;
    rounds are written, so lost executors cost one round. start: labels from earlier edges, which hold on.
    """
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")  # edges are computed once
    both = work.table(edges.where("a <> b").select(ends).select("e.a", "e.b"), f"{name}-edges")
    if both.isEmpty() and start is not None:
        return start
    if start is not None:
        known = start.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        both = both.union(known.select(ends).select("e.a", "e.b")).union(start.where("node = label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    labels = work.table(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        # All joins are of plain shuffled sides, so that the adaptive skew join deals out a label of very many nodes.
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("least"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "least").alias("new"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        step = step.join(jump, F.col("new") == F.col("at"), "left").select("node", F.col("label").alias("old"), F.least("new", "far").alias("label"))
        written = work.table(step, f"{name}-{turn}")
        done = written.where("old <> label").isEmpty()
        labels = written.select("node", "label")
        if done:
            return labels
