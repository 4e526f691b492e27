"""Registered queries on the replayable nightly memory, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions.price import pence
from offerlens.plans.offer_queries import query
from offerlens.session import shared_folder, table
from offerlens.streaming.nights import Memory
from offerlens.streaming.search_log import SearchLog

#: A night of each year's offers: of each product the offer of the least shop (as text), then price.
_NIGHTS = """n AS (SELECT *, dense_rank() OVER (ORDER BY night) AS i FROM (
        SELECT CAST(l_partkey AS VARCHAR) AS key, CAST(l_suppkey AS VARCHAR) AS shop, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(date_trunc('year', l_shipdate) AS DATE) AS night,
            row_number() OVER (PARTITION BY l_partkey, date_trunc('year', l_shipdate) ORDER BY CAST(l_suppkey AS VARCHAR), round(l_extendedprice * 100)) AS o FROM lineitem) WHERE o = 1),
    c AS (SELECT *, coalesce(price <> lag(price) OVER (PARTITION BY key ORDER BY night), true) AS changed FROM n)"""


def _memory(spark: SparkSession, d: str) -> Memory:
    """The years' nights, taken in an order that isn't theirs, and one of them twice."""
    offers = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("key"), F.col("l_suppkey").cast("string").alias("shop"), pence(F.col("l_extendedprice")).alias("price"), F.lit("GBP").alias("currency"), F.lit(None).cast("boolean").alias("on_sale"), F.trunc("l_shipdate", "year").alias("night"))
    years = [r.night for r in offers.select("night").distinct().orderBy("night").collect()]
    memory = Memory(spark, f"{shared_folder(spark)}/memory-{uuid.uuid4().hex}")
    for year in [*years[:2], *years[3:], *years[2:3], *years[-1:]]:
        memory.remember(year, offers.where(F.col("night") == F.lit(year)))
    return memory


@query(
    "str3_nightly_state",
    f"""WITH {_NIGHTS} SELECT key, arg_max(shop, night) AS shop, arg_max(price, night) AS price, min(night) AS first_seen, max(night) AS last_seen, count(*) AS nights_seen,
        max(CASE WHEN changed THEN night END) AS price_since, CAST(sum(1 << (m - i)) AS BIGINT) AS seen_nights
    FROM (SELECT *, max(i) OVER (PARTITION BY key) AS m FROM c) GROUP BY key""",
)
def nightly_state(spark: SparkSession, d: str) -> DataFrame:
    """What the memory knows of each product after all nights."""
    return _memory(spark, d).state().drop("currency")


@query("str3_price_records", f"WITH {_NIGHTS} SELECT key, night, price FROM c WHERE changed")
def price_records(spark: SparkSession, d: str) -> DataFrame:
    """The nights on which each product's price changed."""
    return _memory(spark, d).prices().drop("currency")


@query(
    "snk5_search_log",
    """WITH RECURSIVE l AS (
        SELECT CAST(ts AS DATE) AS day, q, strlen(CAST(json_object('q', q) AS VARCHAR)) + 1 AS size, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, q) AS i
        FROM (SELECT ts, concat(event_type, ' ', props) AS q FROM events) WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) - 20 FROM events)
    ), f AS (
        SELECT DISTINCT day, CAST(0 AS BIGINT) AS i, CAST(4000 AS BIGINT) AS room, CAST(NULL AS VARCHAR) AS q FROM l
        UNION ALL
        SELECT l.day, l.i, CASE WHEN size <= room THEN room - size ELSE room END, CASE WHEN size <= room THEN l.q END FROM f JOIN l ON l.day = f.day AND l.i = f.i + 1
    ) SELECT day, q, count(*) AS n FROM f WHERE q IS NOT NULL GROUP BY day, q""",
)
def search_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as searches, logged in two batches (one of them twice), 4,000 bytes a day, 20 days and the latest: what the log holds."""
    searches = table(spark, d, "events").select("ts", F.concat_ws(" ", "event_type", "props").alias("q"))
    log = SearchLog(spark, f"{shared_folder(spark)}/searches-{uuid.uuid4().hex}", most_bytes=4000, keep_days=20)
    for number, half in ((0, F.hour("ts") < 12), (1, F.hour("ts") >= 12), (1, F.hour("ts") >= 12)):
        log.record(searches.where(half), number)
    return log.read().groupBy("day", "q").agg(F.count("*").alias("n"))
