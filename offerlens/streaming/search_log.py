"""A log of searches by day: appended batch by batch, each day up to a size, and kept for a number of days.

Lines stand in `lines/day=.../batch=...`, a JSON object each, and what each batch added to a day in `sizes/batch=...`. A batch that runs
again overwrites its own parts only, so a stream may be restarted at any point. Days that are too old go as whole folders.

A line is kept while the day has room for it; a later, shorter one may still fit after one didn't. That rule is sequential, yet no day
passes through one task: sums by second say which seconds fit whole, and after the first line that doesn't fit there is less room
than that line is long, so of each length only the first few lines can still be taken. These alone are folded, a day at a time.
"""

from __future__ import annotations

from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts in which the first lines of one length are looked for before the parts meet.
PARTS = 64


def _folded(lines: pd.DataFrame) -> pd.DataFrame:
    """Copies taken of one day's lines, in order, while there is room."""
    lines = lines.sort_values(["ts", "line"], kind="stable")
    room, taken = int(lines["gap"].iloc[0]), []
    for size, n in zip(lines["size"], lines["n"], strict=True):
        fit = min(int(n), room // int(size))
        room -= fit * int(size)
        taken.append(fit)
    return lines[["day", "ts", "line"]].assign(n=taken)


def fitting(lines: DataFrame, room: DataFrame, most: int) -> DataFrame:
    """day, ts, line, n (copies kept) of lines(day, ts, line), taken by time, then text, while the day's bytes (a new line's too) stay within `most`.

    room(day, used) says what each day has used before; days without a row are empty. Copies at one time count each. No nulls.
    """
    groups = lines.groupBy("day", "ts", "line").agg(F.count("*").alias("n")).withColumn("size", F.octet_length("line").cast("bigint") + 1).withColumn("second", F.date_trunc("second", "ts"))
    seconds = groups.groupBy("day", "second").agg(F.sum(F.col("n") * F.col("size")).alias("bytes")).join(room, "day", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    seconds = seconds.withColumn("before", F.col("used") + F.sum("bytes").over(Window.partitionBy("day").orderBy("second")) - F.col("bytes"))
    placed = groups.join(seconds, ["day", "second"])
    whole = placed.where(F.col("before") + F.col("bytes") <= most).select("day", "ts", "line", "n")
    # The one second of a day in which room runs out, line by line.
    torn = placed.where((F.col("before") <= most) & (F.col("before") + F.col("bytes") > most))
    earlier = F.col("before") + F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("day").orderBy("ts", "line")) - F.col("n") * F.col("size")
    torn = torn.withColumn("earlier", earlier).where(F.col("earlier") <= most)
    torn = torn.withColumn("fit", F.least("n", F.floor((F.lit(most) - F.col("earlier")) / F.col("size")).cast("bigint")))
    ends = torn.where("fit < n").groupBy("day").agg(F.min(F.struct("ts", "line", (F.lit(most) - F.col("earlier") - F.col("fit") * F.col("size")).alias("gap"))).alias("end"))
    first = torn.join(ends, "day").where(F.struct("ts", "line") <= F.struct("end.ts", "end.line")).select("day", "ts", "line", F.col("fit").alias("n")).where("n > 0")
    later = groups.join(ends, "day").where((F.struct("ts", "line") > F.struct("end.ts", "end.line")) & (F.col("size") <= F.col("end.gap"))).select("day", "ts", "line", "n", "size", F.col("end.gap").alias("gap"))
    part = F.pmod(F.xxhash64("ts", "line"), F.lit(PARTS))
    for keys in (["day", "size", part], ["day", "size"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "line"))
        later = later.withColumn("place", place).where("place * size <= gap").drop("place")
    later = later.groupBy("day").applyInPandas(_folded, "day date, ts timestamp, line string, n bigint").where("n > 0")
    return whole.unionByName(first).unionByName(later)


class SearchLog:
    """A log in a folder that driver and executors share; rows are (ts, q).

    Cases. White space of a query is one space, 300 characters are kept; null or blank queries and null times aren't logged. Times are days
    by the session's time zone. A day older than `keep_days` before the latest logged day isn't begun again. An empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, *, most_bytes: int = 20 * 1024 * 1024, keep_days: int = 365) -> None:
        self.spark, self.folder, self.most, self.keep_days = spark, folder.rstrip("/"), most_bytes, keep_days

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _sizes(self) -> DataFrame:
        fs, path = self._path("sizes")
        schema = "day date, bytes bigint, batch bigint"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/sizes") if fs.exists(path) else self.spark.createDataFrame([], schema)

    def record(self, batch: DataFrame, number: int) -> None:
        """Append one batch; fits foreachBatch. The same number again replaces what it added."""
        text = F.trim(F.substring(F.trim(F.regexp_replace("q", r"\s+", " ")), 1, 300))
        rows = batch.select(F.col("ts").cast("timestamp").alias("ts"), text.alias("q")).where("ts IS NOT NULL AND q <> ''")
        lines = rows.select(F.to_date("ts").alias("day"), "ts", F.to_json(F.struct("q")).alias("line"))
        sizes = self._sizes().where(F.col("batch") < number)
        latest = max([d for d in (lines.agg(F.max("day")).first()[0], sizes.agg(F.max("day")).first()[0]) if d], default=None)
        if latest is None:
            return
        used = sizes.groupBy("day").agg(F.sum("bytes").alias("used"))
        kept = fitting(lines.where(F.col("day") >= F.lit(latest - timedelta(days=self.keep_days))), used, self.most)
        copies = kept.select("line", "day", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).select(F.col("line").alias("value"), "day", F.lit(number).alias("batch"))
        copies.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").text(f"{self.folder}/lines")
        written = self._lines().where(F.col("batch") == number)
        written.groupBy("day").agg(F.sum(F.octet_length("value") + 1).cast("bigint").alias("bytes")).write.mode("overwrite").parquet(f"{self.folder}/sizes/batch={number}")
        self.prune(latest)

    def prune(self, today: date) -> int:
        """Drop the days that are older than `keep_days`; how many went."""
        fs, path = self._path("lines")
        oldest, gone = today - timedelta(days=self.keep_days), 0
        for status in fs.listStatus(path) if fs.exists(path) else []:
            name, _, day = status.getPath().getName().partition("=")
            if name == "day" and day < oldest.isoformat():
                gone += bool(fs.delete(status.getPath(), True))
        return gone

    def _lines(self) -> DataFrame:
        fs, path = self._path("lines")
        schema = "value string, day date, batch bigint"
        return self.spark.read.schema(schema).text(f"{self.folder}/lines") if fs.exists(path) else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """day and q of every line; a predicate on days reads their folders only."""
        return self._lines().select("day", F.get_json_object("value", "$.q").alias("q"))

    def follow(self, searches: DataFrame, checkpoint: str) -> None:
        """Append what a stream of (ts, q) holds by now."""
        searches.writeStream.foreachBatch(self.record).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
