"""Connected components of a link table, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquilt.llm.common import materialize, release


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a, b).

    Each round every node points at its smallest neighbour if that is smaller; pointers are
    followed to their roots; the roots' links go into the next round.  A round at least halves
    the linked roots, and a star ends after two.  Links that repeat, run both ways or join a node
    with itself are fine; an empty table gives an empty one.
    """
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    label = None
    while True:
        #: A round is some ten small jobs; what they leave on the driver goes before the next.
        release(links.sparkSession)
        both = links.union(links.select("b", "a"))
        tree = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        tree = materialize(tree, "tree")
        while True:  # pointer jumping: each pass halves the depth
            top = tree.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = materialize(tree.join(top, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "tree")
            tree = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        label = tree if label is None else label.join(tree.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        label = materialize(label, "labels")
        to = tree.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        links = links.join(to, "a").join(to.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b").where("ra <> rb")
        links = materialize(links.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if links.isEmpty():
            return label.select("node", F.col("up").alias("component"))
