"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (id, component): the smallest id that each linked id reaches.

    Labels fall to the least label around, then jump to their label's own label; stars settle in two rounds and long
    chains in about the logarithm of their length. Each round is written to the shared folder. A hub's edges are
    combined before they are shuffled. An empty table gives an empty one.
    """
    links = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = cut(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = links.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", F.least("component", "near").alias("low"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("further"))
        new = cut(low.join(jump, "low", "left").select("id", F.least("low", F.coalesce("further", "low")).alias("component"), (F.least("low", F.coalesce("further", "low")) != F.col("was")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        drop_cut(labels)
        labels = new.select("id", "component")
        if not moved:
            drop_cut(links)
            return labels
