"""Distributed connected components over an edge table.

Labels hook to the smallest neighbouring label and jump along pointers; edges inside a
component vanish, so each round works on a smaller edge table and a path of n nodes
takes O(log n) rounds. Every round is cut at a table in the shared folder, and nothing
but one count per round reaches the driver. Hubs only meet as the hot side of a plain
equi-join (which adaptive execution splits) or in a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _jump(labels: DataFrame) -> DataFrame:
    up = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return labels.join(up, "label", "left").select("node", F.coalesce("next", "label").alias("label"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (smallest node of its component) for each end of ``edges`` (``u``, ``v``)."""
    edges = materialise(edges.where("u <> v").distinct(), "edges")
    nearest = _both_ways(edges).groupBy("u").agg(F.min("v").alias("v"))
    labels = materialise(nearest.select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        labels = materialise(_jump(_jump(labels)), "labels")
        ends = [labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")) for end in ("u", "v")]
        open_edges = edges.join(ends[0], "u").join(ends[1], "v").where("u_label <> v_label")
        edges = materialise(open_edges.select(F.col("u_label").alias("u"), F.col("v_label").alias("v")).distinct(), "edges")
        if edges.isEmpty():
            #: No edge joins two labels; pointers may still be more than one step long.
            while True:
                after = materialise(_jump(labels), "labels")
                moved = after.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old")
                if moved.isEmpty():
                    return after
                labels = after
        hook = _both_ways(edges).groupBy("u").agg(F.min("v").alias("v")).where("v < u").select(F.col("u").alias("label"), F.col("v").alias("lower"))
        labels = labels.join(hook, "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
        labels = materialise(labels, "labels")
