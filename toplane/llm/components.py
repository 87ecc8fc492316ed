"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toplane.llm.shared import stored


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of a link: root is the least node that it reaches.

    In each round every node takes the least label among itself and its
    neighbours, then the label of that label; labels halve their distance to
    the root, so rounds grow with the logarithm of the longest path.  Sums by
    node are combined before they move, so a hub is no hot key; rounds are
    written to the shared folder.
    """
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    edges = stored(edges.union(edges.select("y", "x")).distinct())
    labels = stored(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("root")))
    while True:
        near = edges.join(labels, edges["y"] == labels["node"]).groupBy("x").agg(F.min("root").alias("best"))
        step = labels.join(near, labels["node"] == near["x"]).select("node", F.least("root", "best").alias("root"))
        step = stored(step)
        to = step.select(F.col("node").alias("of"), F.col("root").alias("next"))
        jumped = stored(step.join(to, step["root"] == to["of"], "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root")))
        old = labels.select(F.col("node").alias("was"), F.col("root").alias("before"))
        changed = jumped.join(old, jumped["node"] == old["was"]).filter("root <> before").limit(1).count()
        labels = jumped
        if not changed:
            return labels
