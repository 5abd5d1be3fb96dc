"""Connected components over a table of links, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryframe.llm._base import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b): the smallest node of its component.

    Each round takes the smallest label of the neighbours (partial minima come before the shuffle) and
    then the label's own label, so long chains shrink in a logarithmic number of rounds. Each round is written,
    so a lost executor costs one round. Null ends and loops are ignored.
    """
    both = links.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = materialize(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["node"] == near["n"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("n2"), F.col("label").alias("up"))
        lower = lower.join(up, lower["label"] == up["n2"], "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old")
        done = materialize(lower, "labels")
        labels = done.select("node", "label")
        if not done.where("label <> old").head(1):
            return labels
