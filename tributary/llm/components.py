"""Connected components of a link table by smallest labels and pointer jumping, entirely in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the smallest node of its component. Only counts come to the driver.

    Each round gives a node the smallest label among its own and its neighbours', then that label's label; the number of rounds is logarithmic for
    chains of hubs and never more than the longest path.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = written(both.where("u <> v").distinct(), "links", 2 * links.count())
    n = edges.count()
    labels = written(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")), "labels", n)
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), F.col("root").alias("r")), "v").groupBy(F.col("u").alias("node")).agg(F.min("r").alias("r"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        lower = written(lower, "labels", n)
        jump = lower.join(lower.select(F.col("node").alias("root"), F.col("root").alias("further")), "root").select("node", F.least("root", "further").alias("root"), "old")
        after = written(jump, "labels", n)
        changed = after.where("root <> old").limit(1).count()
        drop_written(lower)
        drop_written(labels)
        labels = after.select("node", "root")
        if not changed:
            drop_written(edges)
            return labels
