"""Hierarchies of kinds: what is broader than what, at any number of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.session import shared_folder


def closure(edges: DataFrame) -> DataFrame:
    """kind, broader and steps (the least number of them) of edges(kind, broader), at any number of steps.

    Each round joins the paths found so far with themselves, so that their length doubles: the rounds are the logarithm of the depth. Every
    round is checkpointed where all executors see it. A kind on a cycle is broader than itself nowhere: such rows are left out, and
    the rounds end as no pair is new or shorter. A broader kind that has no row of its own is a kind without broader ones. Nulls and
    repeated edges add nothing.
    """
    shared_folder(edges.sparkSession)
    paths = edges.select("kind", "broader").where("kind <> broader").distinct().withColumn("steps", F.lit(1).cast("bigint")).checkpoint()
    state = None
    while True:
        now = tuple(paths.agg(F.count("*"), F.sum("steps")).first())
        if now == state:
            return paths
        state = now
        on = paths.select(F.col("kind").alias("middle"), F.col("broader").alias("far"), F.col("steps").alias("more"))
        longer = paths.join(on, F.col("broader") == F.col("middle")).where("kind <> far").select("kind", F.col("far").alias("broader"), (F.col("steps") + F.col("more")).alias("steps"))
        paths = paths.unionByName(longer).groupBy("kind", "broader").agg(F.min("steps").alias("steps")).checkpoint()


def depths(kinds: DataFrame, paths: DataFrame) -> DataFrame:
    """kind and depth, how many kinds are broader, of kinds(kind)."""
    counted = paths.groupBy("kind").agg(F.count("*").alias("depth"))
    return kinds.select("kind").distinct().join(counted, "kind", "left").select("kind", F.coalesce("depth", F.lit(0)).alias("depth"))


def narrowest(members: DataFrame, paths: DataFrame) -> DataFrame:
    """Each member's narrowest kind, of members(member, kind): the one below most others, ties to the greater name; markers (`__...`) aren't kinds, and a member with nothing else has ""."""
    ranked = members.join(depths(members, paths), "kind", "left")
    real = ~F.col("kind").startswith("__")
    best = F.max(F.when(real, F.struct("depth", "kind")))
    return ranked.groupBy("member").agg(best.alias("best")).select("member", F.coalesce("best.kind", F.lit("")).alias("kind"), F.coalesce("best.depth", F.lit(0)).cast("bigint").alias("depth"))


def related(left: DataFrame, right: DataFrame, paths: DataFrame) -> DataFrame:
    """Pairs of left(kind, ...) and right(other, ...) whose kinds are equal, or one is broader than the other: relation is same, broader (the right one is) or narrower."""
    up = paths.select("kind", F.col("broader").alias("other"), F.lit("broader").alias("relation"))
    down = paths.select(F.col("broader").alias("kind"), F.col("kind").alias("other"), F.lit("narrower").alias("relation")).join(up.select("kind", "other"), ["kind", "other"], "left_anti")
    same = left.select("kind").distinct().select("kind", F.col("kind").alias("other"), F.lit("same").alias("relation"))
    return left.join(up.unionByName(down).unionByName(same), "kind").join(right, "other")
