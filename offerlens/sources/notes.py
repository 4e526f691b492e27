"""Price notes: a key's whole price history as one short text, and back.

A note holds a history's changes only, a space between them: the first night as days since 1970 and its price, then the days and the pence by which each change differs from the one
before, `19000:1299 7:-100 21:50`. No price (null) is written `-`, and the next number then counts from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(sightings: DataFrame) -> DataFrame:
    """The rows of sightings(key, night, price) on which a key's price isn't the one before. Of several rows a night the least price counts."""
    nightly = sightings.where("key IS NOT NULL AND night IS NOT NULL").groupBy("key", "night").agg(F.min("price").alias("price"))
    order = Window.partitionBy("key").orderBy("night")
    first = F.row_number().over(order) == 1
    kept = nightly.withColumn("new", first | ~F.lag("price").over(order).eqNullSafe(F.col("price")))
    return kept.where("new").select("key", "night", "price")


def written(history: DataFrame) -> DataFrame:
    """key and note of history(key, night, price), one row a change: a key has one a night at most."""
    order = Window.partitionBy("key").orderBy("night")
    day = F.unix_date("night")
    days = day - F.coalesce(F.lag(day).over(order), F.lit(0))
    price = F.coalesce((F.col("price") - F.coalesce(F.lag("price").over(order), F.lit(0))).cast("string"), F.lit("-"))
    parts = history.select("key", "night", F.concat_ws(":", days.cast("string"), price).alias("part"))
    own = F.array_sort(F.collect_list(F.struct("night", "part")))
    return parts.groupBy("key").agg(F.array_join(F.transform(own, lambda p: p["part"]), " ").alias("note"))


def read(notes: DataFrame) -> DataFrame:
    """key, night and price of notes(key, note): what was written. Parts that aren't two numbers are an error."""

    def step(done: Column, part: Column) -> Column:
        before = F.element_at(done, -1)
        days, pence = F.split_part(part, F.lit(":"), F.lit(1)).cast("int"), F.split_part(part, F.lit(":"), F.lit(2))
        price = F.when(pence != "-", F.coalesce(before["price"], F.lit(0)) + F.nullif(pence, F.lit("-")).cast("bigint"))
        return F.concat(done, F.array(F.struct((before["day"] + days).alias("day"), price.alias("price"))))

    start = F.array(F.struct(F.lit(0).alias("day"), F.lit(None).cast("bigint").alias("price")))
    all_ = F.aggregate(F.filter(F.split("note", " "), lambda p: p != ""), start, step)
    return notes.where("note IS NOT NULL").select("key", F.explode(F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 1, F.lit(0)))).alias("r")).select("key", F.date_from_unix_date("r.day").alias("night"), F.col("r.price").alias("price"))
