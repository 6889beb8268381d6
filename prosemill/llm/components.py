"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.storage import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges: one long, two long. Returns node long, component long (its least node) for every node of an edge.

    Each round a node takes the least label of its neighbours and itself, then the label of that label, so labels travel
    twice as far each time. Rounds are written tables; minima combine before the shuffle, so a hub is no single task.
    """
    both = scratch.write(edges.select(F.col("one").alias("node"), F.col("two").alias("other")).unionByName(edges.select(F.col("two").alias("node"), F.col("one").alias("other"))).where("node <> other").distinct(), f"{name}-edges")
    labels = scratch.write(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), f"{name}-0")
    number = 0
    while True:
        number += 1
        heard = both.join(labels.withColumnsRenamed({"node": "other", "label": "heard"}), "other").groupBy("node").agg(F.min("heard").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = scratch.write(lower.join(roots, "label", "left").select("node", "was", F.least("label", "further").alias("label")), f"{name}-{number}")
        changed = not new.where("label <> was").isEmpty()
        scratch.drop(f"{name}-{number - 1}")
        labels = new.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
