"""Connected components of links, by alternating large and small stars.

Every round is two aggregations and two joins over the links, written to the shared folder; nothing is gathered in one task
or at the driver. Links must have two ends that aren't null; loops and repeated links are fine. No links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Points neighbours at the least one: the greater neighbours of a node (large), or the lesser ones and the node itself (small). links: pairs a > b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy(F.col("a").alias("__a")).agg(F.min("b").alias("m"))
    if large:
        least = least.withColumn("m", F.least("m", "__a"))
    moved = both.join(least, F.col("a") == F.col("__a"))
    pairs = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else moved.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p")).select("p.a", "p.b")
    return pairs.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root, its component's least node, for every node of links(a, b) that isn't a root itself."""
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    state = None
    while True:
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if after == state or not after[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = after
        now = stored(_star(_star(now, True), False), "links")
