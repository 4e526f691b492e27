"""Groups from ties: connected components of pairs, by passing on the least label along the pairs and along the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.session import shared_folder


def groups(nodes: DataFrame, ties: DataFrame) -> DataFrame:
    """node and group (its least node) of nodes(node) with ties(a, b). Each round's labels are checkpointed where all executors see them."""
    shared_folder(nodes.sparkSession)
    both = ties.select("a", "b").unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    labels = nodes.select("node", F.col("node").alias("group")).distinct()
    total = None
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("group").alias("least"))
        told = labels.join(seen, F.col("node") == F.col("a"), "left").select("node", F.least("group", F.coalesce("least", "group")).alias("group"))
        # A label has a label of its own by now, at least as small.
        own = told.select(F.col("node").alias("n2"), F.col("group").alias("g2"))
        labels = told.join(own, F.col("group") == F.col("n2"), "left").select("node", F.least("group", F.coalesce("g2", "group")).alias("group")).checkpoint()
        now = labels.agg(F.sum(F.col("group").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
