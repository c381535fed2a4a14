"""Connected components of links by label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import cut

#: Rounds of plain propagation before labels also jump to their labels' labels.
PLAIN = 5


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of ``links`` (a, b long) the least node reachable.

    Each round hands labels over all links (the join splits hubs, the minimum is taken
    before the shuffle); after ``PLAIN`` rounds labels also jump, so that long chains
    take a logarithmic number of rounds. Every round is cut off from the ones before.
    """
    links = links.where("a <> b")
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component"), F.lit(True).alias("new")))
    rounds = 0
    while not labels.where("new").isEmpty():
        heard = both.join(labels.select(F.col("node").alias("a"), "component"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("heard"))
        after = labels.select("node", "component").join(heard, "node").select("node", F.least("component", "heard").alias("component"), (F.col("heard") < F.col("component")).alias("new"))
        after = cut(after)
        rounds += 1
        if rounds > PLAIN:
            further = after.select(F.col("node").alias("component"), F.col("component").alias("further"))
            after = cut(after.join(further, "component").select("node", F.col("further").alias("component"), F.expr("new OR further < component").alias("new")))
        labels = after
    return labels.select("node", "component")
