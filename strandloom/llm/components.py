"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import cut, discard


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every end of an edge (a, b), as a table of the shared folder.

    Each round takes the smallest label among neighbours (summed before the shuffle, so a hub costs one row for
    each task) and then the label of that label. Labels only fall, and the loop ends when none does. Edges with a
    null end are left out; loops and repeated edges change nothing; no edges give no rows. The edges are computed
    once, for both directions, so edges that come out differently each time are still those of one undirected graph.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(edges.where("a <> b").select(F.explode(ways).alias("edge")).select("edge.*").distinct(), "edges")
    first = both.groupBy("a").agg(F.min("b").alias("least"))
    labels = cut(first.select(F.col("a").alias("id"), F.least("a", "least").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = F.least("component", "near").alias("component")
        hooked = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("was"), lower)
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        further = F.least("component", F.coalesce("further", "component")).alias("component")
        moved = cut(hooked.join(jump, "component", "left").select("id", "was", further), "labels")
        discard(labels)
        labels = moved.select("id", "component")
        labels.cut_path = moved.cut_path
        if moved.where("was <> component").isEmpty():
            discard(both)
            return labels
