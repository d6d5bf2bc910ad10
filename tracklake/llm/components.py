"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Up to so many nodes the labels (two longs each) go along by broadcast, and few tasks do a round;
#: beyond, the same joins are shuffled.
SMALL_NODES = 300_000
SMALL_TASKS = 8


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``links`` (a long, b long).

    Every round a node takes the smallest label around it and then that label's own label,
    which shortens chains to a half.  The largest group of links of one node is reduced on
    the map side.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    small = labels.count() <= SMALL_NODES

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    while True:
        around = both.join(side(labels), F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.select("node", "label")
        at = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        # every node has a link, so the inner joins keep all
        next_ = around.join(side(own), F.col("a") == F.col("node")).select("node", "label", F.least("label", "near").alias("to"))
        jumped = next_.join(side(at), "to").select("node", F.least("to", "beyond").alias("label"), (F.least("to", "beyond") < F.col("label")).alias("moved"))
        done = materialize(jumped.coalesce(SMALL_TASKS) if small else jumped)
        labels = done.select("node", "label")
        if not done.filter("moved").limit(1).count():
            return labels.withColumnRenamed("label", "component")
