"""Connected components by joins, for edge lists of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loom.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b); component is the smallest node reachable.

    Each round takes the least label among a node and its neighbours, then jumps to that label's own
    label, which halves long chains; every round is a table in the shared folder, and the one
    before it goes.  Rows of a hub or of a large component's label are two numbers, and adaptive
    execution splits their partitions.  Loops, repeated edges and an empty list are fine.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("label")), "labels")
    last = None
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("next"))
        # a label is a node with a label of its own: where it has sunk, follow it
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("further"))
        after = materialise(step.join(jump, "next").select("node", F.least("next", "further").alias("now"), "label"), "labels")
        if after.where("now < label").isEmpty():
            discard(both, labels, *([last] if last is not None else []))
            return after.select("node", F.col("now").alias("component"))
        discard(*([last] if last is not None else [labels]))
        last, labels = after, after.select("node", F.col("now").alias("label"))
