"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node with an edge to another (long columns ``a,
    b``): the label is the smallest node of the component.

    In a round every node points at the smallest node around it and follows the
    pointers to their end; then the edges are renamed to the ends, and those
    within one end are settled and leave the table.  Every round writes its
    tables; hot nodes meet partial aggregates, and joins whose other side has
    one row per key."""
    def distinct_edges(pairs: DataFrame) -> DataFrame:
        return staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                      .filter("a <> b").distinct(), "component-edges")

    edges, labels = distinct_edges(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = staged(both.groupBy("a").agg(F.min("b").alias("near")).select(
            F.col("a").alias("node"), F.least("a", "near").alias("label")), "component-step")
        while True:
            up = ends.select(F.col("node").alias("label"), F.col("label").alias("top"))
            step = staged(ends.join(up, "label").select("node", "label", "top"), "component-step")
            ends = step.select("node", F.col("top").alias("label"))
            if step.filter("label <> top").isEmpty():
                break
        renamed = ends.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = ends if labels is None else staged(labels.join(renamed, "label", "left").select(
            "node", F.coalesce("top", "label").alias("label")), "component-labels")
        edges = distinct_edges(
            edges.join(ends.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
            .join(ends.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
            .select(F.col("x").alias("a"), F.col("y").alias("b")))
        if edges.isEmpty():
            return labels


def spanning(labels: DataFrame) -> DataFrame:
    """Edges ``a, b`` that join every node to its label: the components found so
    far in one edge a node, to which further edges are added."""
    return labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
