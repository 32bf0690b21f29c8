"""Connected components of a distributed edge list.

Alternates two steps until labels stay: every vertex takes the smallest label among its own and
its neighbours' (one shuffle, combined on the map side), then labels jump to their label's label.
Each round is written to the shared folder, so lineage stays short and lost executors cost little.
Only the number of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coralint.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``edges(a, b)``; component is the smallest id reachable.

    Loops and repeated edges are allowed. A long chain of n vertices takes about log n rounds.
    """
    links = edges.select("a", "b").filter("a <> b")
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "cc-labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near.withColumnRenamed("a", "id"), "id").select(
            "id", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        # A label is a vertex, so its own label is known: jump.
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = stored(
            lower.join(jump, "label", "left").select("id", "was", F.coalesce("further", "label").alias("label")), "cc-labels"
        )
        labels = step.select("id", "label")
        if step.filter("was <> label").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")
