"""Connected components of an edge table, by rounds of minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard
from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Each round every node takes the smallest label among itself and its neighbours, and then the label of
    that label, so that a path shrinks by more than half a round. Labels are written each round: the plan stays
    short, lost executors cost one round at most, and both sides of every join are plain exchanges that
    adaptive execution can split when one component holds most nodes. Only a count comes to the driver.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).filter("u <> v")
    both = materialize(both, "links")
    written = labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("root").alias("m"))
        hooked = materialize(labels.join(near, labels["node"] == near["u"]).select("node", F.least("root", "m").alias("root"), F.col("root").alias("was")), "hooked")
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = materialize(hooked.join(above, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("was")).alias("moved")), "labels")
        discard(written, hooked)
        written, labels = jumped, jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            discard(both)
            return labels
