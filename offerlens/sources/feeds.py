"""Feeds in and out: CSV, JSON, logs by day, taxonomies, site maps, and a nightly memory of offers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.functions.text import digest_id, filled

#: Keys under which a JSON feed may hold its rows.
LISTS = ("products", "items", "rows", "data")


def csv_feed(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV feed with a header as text columns. Rows with more fields than the header are dropped whole; empty ones become null.

    The columns are stated, so no pass over the file infers them; a predicate on them is applied while the file is parsed.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "__bad"]])
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").csv(path)
    return rows.where("__bad IS NULL").select(*[filled(F.col(c)).alias(c) for c in columns])


def json_feed(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A JSON feed as text columns: a list of objects, an object that holds one under a known key, or one object."""
    row = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    schema = T.StructType([*row.fields, *[T.StructField(k, T.ArrayType(row)) for k in LISTS if k not in columns]])
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    lists = F.coalesce(*[F.col(k) for k in LISTS if k not in columns])
    one = F.array(F.struct(*columns))
    return rows.select(F.explode(F.when(lists.isNotNull(), lists).otherwise(one)).alias("row")).select(*[filled(F.col(f"row.{c}")).alias(c) for c in columns])


def search_log(spark: SparkSession, path: str) -> DataFrame:
    """Logged queries (day, q) of files named by day, a JSON object a line; lines that aren't are passed over."""
    lines = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1).alias("day"))
    return lines.select(F.try_to_date("day").alias("day"), F.get_json_object("value", "$.q").alias("q")).where("q IS NOT NULL")


def taxonomy(lines: DataFrame, column: str) -> DataFrame:
    """Paths ("12 - A > B > C") as records: id, path, leaf, parent, depth. Blank lines and comments are passed over."""
    text = F.trim(F.regexp_replace(column, r"^\s*\d+\s*-\s*", ""))
    parts = F.transform(F.split("path", r"\s*>\s*"), lambda x: F.trim(x))
    rows = lines.select(text.alias("path")).where("path <> '' AND NOT path LIKE '#%'").withColumn("parts", parts)
    return rows.select(digest_id("node_", F.array_join("parts", ">")).alias("node_id"), F.array_join("parts", " > ").alias("path"), F.element_at("parts", -1).alias("leaf"), F.when(F.size("parts") > 1, F.element_at("parts", -2)).alias("parent"), F.size("parts").cast("bigint").alias("depth"))


def site_map(urls: DataFrame, size: int, order: Column) -> DataFrame:
    """url and the number of its batch, in order. Places are counted in salted ranges, not in one task."""
    ranged = urls.withColumn("__range", F.substring(F.sha2("url", 256), 1, 2))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("__range")) - F.col("n"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return ranged.withColumn("place", place).join(F.broadcast(counts.drop("n")), "__range").select("url", F.floor((F.col("before") + F.col("place") - 1) / size).cast("bigint").alias("batch"))


def remembered(memory: DataFrame, tonight: DataFrame, night: str) -> DataFrame:
    """The nightly merge: memory(key, first_seen, last_seen, nights_seen, price, changed_on) with tonight(key, price).

    The same night again replaces its own part: a key already seen on that night isn't counted twice.
    """
    on = F.to_date(F.lit(night))
    both = memory.alias("m").join(tonight.alias("t"), "key", "full")
    seen, again = F.col("t.price").isNotNull(), F.col("m.last_seen") == on
    changed = seen & ~F.col("m.price").eqNullSafe(F.col("t.price"))
    return both.select(
        "key",
        F.coalesce("m.first_seen", on).alias("first_seen"),
        F.when(seen, on).otherwise(F.col("m.last_seen")).alias("last_seen"),
        (F.coalesce("m.nights_seen", F.lit(0)) + F.when(seen & ~F.coalesce(again, F.lit(False)), 1).otherwise(0)).cast("bigint").alias("nights_seen"),
        F.coalesce("t.price", "m.price").alias("price"),
        F.when(changed, on).otherwise(F.col("m.changed_on")).alias("changed_on"),
    )
