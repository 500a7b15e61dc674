"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """v, label: of every vertex of ``edges`` (a, b), the smallest vertex that it reaches.

    Each round takes the smallest label among the neighbours, then the label's own
    label, so that a path's length halves; rounds end when nothing changes. Labels
    are written after each.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = cut(both, "edges")
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = cut(step.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        if new.where("label != old").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """v, label of the components of ``labels`` and ``links`` (a, b): links count between components, so few are left of them."""
    if labels is None:
        return components(links)
    for c in "ab":
        links = links.join(labels.select(F.col("v").alias(c), F.col("label").alias(f"of_{c}")), c, "left").withColumn(c, F.coalesce(f"of_{c}", c)).select("a", "b")
    between = components(links).withColumnsRenamed({"v": "was", "label": "now"})
    moved = labels.join(between, F.col("label") == F.col("was"), "left").select("v", F.coalesce("now", "label").alias("label"))
    fresh = between.join(labels.select(F.col("v").alias("was")), "was", "left_anti").select(F.col("was").alias("v"), F.col("now").alias("label"))
    return cut(moved.unionByName(fresh), "labels")
