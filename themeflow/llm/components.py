"""Connected components of links between long ids, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeflow.llm.stored import Stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> Stored:
    """(node, component) for every node in ``links``; the component is its
    smallest node. Each round sends every node the smallest label around it
    and then follows labels once (pointer jumping); a node with many links
    gets partial minima, one row per task. Rounds end when nothing changes."""
    both = Stored(links.select(F.col(a).alias("node"), F.col(b).alias("other"))
                  .unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct(), "cc-links")
    labels = Stored(both.read().groupBy("node").agg(F.min("other").alias("m"))
                    .select("node", F.least("node", "m").alias("component")), "cc-labels")
    while True:
        now = labels.read()
        near = (both.read().join(now.select(F.col("node").alias("other"), "component"), "other")
                .groupBy("node").agg(F.min("component").alias("near")))
        less = (now.join(near, "node")
                .select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")))
        less = Stored(less, "cc-round")
        labels.drop()
        if not less.read().filter("component < old").limit(1).count():
            both.drop()
            return less
        to = less.read().select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = Stored(less.read().join(to, "component", "left").select(
            "node", F.least("component", F.coalesce("further", "component")).alias("component")), "cc-labels")
        less.drop()
