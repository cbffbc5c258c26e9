"""Connected components by joins over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalane.session import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node that it is linked to.

    Each round takes the least root over a node's neighbours and then that root's own root, so paths halve.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(both, "edges")
    roots = table = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        r = roots.select(F.col("node").alias("b"), F.col("root").alias("r"))
        near = edges.join(r, "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        step = roots.join(near, "node").select("node", "root", F.least("root", "r").alias("low"))
        over = roots.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = written(step.join(over, "low").select("node", F.least("low", "far").alias("root"), (F.least("low", "far") != F.col("root")).alias("moved")), "roots")
        dropped(table)
        table = new
        if new.where("moved").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")
