"""Structured Streaming on event files: daily counts kept up to date batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlens.session import shared_folder


def day_counts(spark: SparkSession, folder: str, *, late: str | None = None, files_per_batch: int = 50) -> DataFrame:
    """event_type, day, n of the events.parquet files in a folder, read as a stream until it is used up.

    State is a count for each type and day. Files may come in any order; only who names a time for late events lets older state go, and their later events with it. Every batch appends the counts that it changed under its
    own number, so a batch that runs again overwrites its own files only; the last count of a key is the one that holds.
    """
    place = f"{shared_folder(spark)}/event-days-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/events.parquet")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    watched, names = (f"{folder}/events.parquet", "*.parquet") if whole else (folder, "events.parquet")  # a stream watches a folder
    events = spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", files_per_batch).parquet(watched).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = (events.withWatermark("ts", late) if late else events).groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("date").alias("day"), "n")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/counts/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    last = Window.partitionBy("event_type", "day").orderBy(F.desc("batch"))
    return spark.read.parquet(f"{place}/counts").withColumn("rn", F.row_number().over(last)).where("rn = 1").select("event_type", "day", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of a user that end after a gap without events; the same code for a stream with a watermark."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events")).select("user_id", F.col("s.start").alias("first_ts"), "n_events")
