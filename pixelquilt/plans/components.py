"""Connected components of a link table in logarithmic rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquilt.plans.scratch import materialize


def connected(links: DataFrame) -> DataFrame:
    """(node, component): the component of each node of ``links`` (a, b), named by one of its nodes.

    In each round a node hangs itself below its smallest neighbour, where that is smaller; chains are
    cut to half their length until all hang below a root; links between different roots remain for
    the next round, with at most half as many roots.  Nodes may be of any type with an order.
    """
    links = materialize(links.where("a <> b").distinct(), "links")
    found = None
    while not links.isEmpty():
        ends = links.union(links.select("b", "a")).toDF("node", "near")
        above = materialize(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up")), "above")
        while True:
            over = above.select(F.col("node").alias("up"), F.col("up").alias("top"))
            above = materialize(above.join(over, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "above")
            if above.where("moved").isEmpty():
                break
            above = above.drop("moved")
        roots = above.select("node", "up")
        if found is None:
            found = roots
        else:
            found = materialize(found.join(roots.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("up")), "components")
        a, b = roots.select(F.col("node").alias("a"), F.col("up").alias("ra")), roots.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        links = materialize(links.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    return (links.toDF("node", "up") if found is None else found).select("node", F.col("up").alias("component"))
