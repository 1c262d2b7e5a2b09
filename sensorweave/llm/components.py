"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import files_for, written


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for every end of ``edges`` (columns a, b of one type).

    Each round every node joins its smallest neighbour and the edges are
    rewritten between what the nodes became, without loops and repeats.  A round
    at least halves the nodes that are left, so there are few rounds whatever
    the shape, and the table shrinks.  Rounds are written to the shared folder.
    Edges with a null end are ignored; without edges the result is empty.
    """
    left = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    few = files_for(left)  # what follows is no larger
    labels = None
    while True:
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = written(ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")).coalesce(few), "parents")
        if labels is None:
            labels = joined.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            labels = labels.join(joined.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        to_a = joined.select("a", F.col("p").alias("new_a"))
        to_b = joined.select(F.col("a").alias("b"), F.col("p").alias("new_b"))
        moved = left.join(to_a, "a").join(to_b, "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))
        left = written(moved.where("a <> b").distinct().coalesce(few), "edges")
        if left.isEmpty():
            return written(labels.coalesce(few), "components")
