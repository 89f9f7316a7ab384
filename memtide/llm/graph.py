"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label), a stashed table: the smallest node of each node's component; nodes without edges are not listed.

    Each round every node takes the least label among its neighbours' and then its label's own label
    (pointer jumping), so rounds grow with the logarithm of a component's diameter, not with it.  Only
    the number of changed labels comes to the driver; every round is a table in the shared folder.
    """
    one = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("s"), F.col(b).alias("t"))
    both = base.stash(one.union(one.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct(), "edges")
    labels = base.stash(both.groupBy(F.col("s").alias("node")).agg(F.least(F.min("t"), F.col("s")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("t"), "label"), "t").groupBy(F.col("s").alias("node")).agg(F.min("label").alias("low"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = base.stash(step.join(jump, "label").select("node", "old", F.least("label", "root").alias("label")), "labels")
        base.drop_path(edges.sparkSession, labels._stashed_at)
        labels = new
        if not new.where("label <> old").limit(1).count():
            base.drop_path(edges.sparkSession, both._stashed_at)
            return labels
