"""Registered queries on feeds that are written from the given tables in several forms and read back, with the SQL of what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions.price import pence
from offerlens.operators.batches import batched
from offerlens.plans.offer_queries import query
from offerlens.session import shared_folder, table
from offerlens.sources import notes, sniffed

COLUMNS = ("id", "name", "brand", "size", "note")


def written(spark: SparkSession, d: str) -> str:
    """The parts as four feeds: by comma in UTF-8, by semicolon in packed Latin-1, as lines of JSON, and by tab with an empty column."""
    part = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("size"), F.concat(F.lit(" é, “ö”; "), F.col("p_type"), F.lit(" ")).alias("note"), "p_type")
    folder = f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}"
    of = lambda *kinds: part.where(F.col("p_type").isin(*kinds)).drop("p_type")
    of("ECONOMY", "LARGE").write.option("header", True).csv(f"{folder}/a")
    of("MEDIUM").withColumn("note", F.translate("note", "“”", "''")).select("size", "id", "note", "name", "brand").write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").option("compression", "gzip").csv(f"{folder}/b")
    of("PROMO", "SMALL").write.json(f"{folder}/c")
    of("STANDARD").withColumn("empty", F.lit(None).cast("string")).drop("brand").write.option("header", True).option("sep", "\t").csv(f"{folder}/d")
    return folder


_NOTE = "' é, “ö”; ' || p_type || ' '"


@query(
    "src3_sniffed_feeds",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CASE WHEN p_type <> 'STANDARD' THEN p_brand END AS brand, CAST(p_size AS VARCHAR) AS size,
        trim(CASE WHEN p_type = 'MEDIUM' THEN translate({_NOTE}, '“”', '''''') ELSE {_NOTE} END) AS note FROM part""",
)
def sniffed_feeds(spark: SparkSession, d: str) -> DataFrame:
    """All parts, from feeds of four forms."""
    return sniffed.feed(spark, written(spark, d), COLUMNS)


@query("src3_pushed_predicate", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part WHERE p_brand = 'Brand#13' AND p_type <> 'STANDARD'")
def pushed_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one brand; the predicate reaches the readers."""
    return sniffed.feed(spark, written(spark, d), ("id", "name", "brand"), F.col("brand") == "Brand#13").drop("brand")


@query(
    "src6_second_feed",
    """SELECT l_orderkey, l_linenumber, s_name AS shop, CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
    WHERE l_returnflag = 'N' AND l_extendedprice > 0 AND l_quantity > 0 AND p_type IS NOT NULL AND lower(trim(s_name)) NOT IN (SELECT lower(trim(s_name)) FROM supplier WHERE s_acctbal < 5000 AND s_name IS NOT NULL)""",
)
def second_feed(spark: SparkSession, d: str) -> DataFrame:
    """Offers of shops that the first feed (suppliers of a low balance) doesn't have."""
    shops = table(spark, d, "supplier")
    rows = table(spark, d, "lineitem").join(shops, F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    feed = rows.select("l_orderkey", "l_linenumber", F.col("s_name").alias("shop"), F.col("l_returnflag").alias("currency"), pence(F.col("l_extendedprice")).alias("price"), F.col("l_quantity").alias("stock"), F.col("p_type").alias("category"))
    first = shops.where("s_acctbal < 5000").select(F.upper(F.concat(F.lit(" "), "s_name")).alias("shop"))
    return sniffed.second_feed(feed, first, "N").select("l_orderkey", "l_linenumber", "shop", "price")


@query(
    "snk8_job_batches",
    """WITH RECURSIVE s AS MATERIALIZED (SELECT l_orderkey AS set_id, CAST(sum(l_quantity) AS BIGINT) AS listings, row_number() OVER (ORDER BY l_orderkey) AS i FROM lineitem GROUP BY 1),
    c AS MATERIALIZED (SELECT *, sum(listings) OVER (ORDER BY i) AS total FROM s),
    e AS MATERIALIZED (SELECT a.i, greatest(a.i + 1, min(CASE WHEN b.i >= a.i + 25 OR b.total - a.total + a.listings > 1000 THEN b.i ELSE a.i + 25 END)) AS next FROM c a JOIN c b ON b.i BETWEEN a.i AND a.i + 25 GROUP BY a.i),
    b AS (SELECT CAST(1 AS BIGINT) AS start, CAST(0 AS BIGINT) AS batch UNION ALL SELECT e.next, b.batch + 1 FROM b JOIN e ON e.i = b.start)
    SELECT set_id, listings, max(batch) OVER (ORDER BY i) AS batch FROM s LEFT JOIN b ON b.start = s.i""",
)
def job_batches(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sets of their pieces, in jobs of 25 sets and 1,000 pieces at most."""
    sets = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("set_id")).agg(F.sum("l_quantity").cast("bigint").alias("listings"))
    return batched(sets, "set_id", "listings", 25, 1_000)


_CHANGES = """n AS (SELECT l_partkey AS key, CAST(l_shipdate AS DATE) AS night, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price FROM lineitem GROUP BY ALL),
    c AS (SELECT key, night, price FROM (SELECT *, lag(price) OVER (PARTITION BY key ORDER BY night) AS was FROM n) WHERE was IS DISTINCT FROM price)"""


def _notes(spark: SparkSession, d: str) -> DataFrame:
    sightings = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_shipdate").cast("date").alias("night"), pence(F.col("l_extendedprice")).alias("price"))
    return notes.written(notes.changes(sightings))


@query(
    "snk4_price_notes",
    f"""WITH {_CHANGES}, d AS (SELECT *, (night - DATE '1970-01-01') - coalesce(lag(night - DATE '1970-01-01') OVER w, 0) AS days, price - coalesce(lag(price) OVER w, 0) AS pence FROM c WINDOW w AS (PARTITION BY key ORDER BY night))
    SELECT key, string_agg(days || ':' || pence, ' ' ORDER BY night) AS note FROM d GROUP BY key""",
)
def price_notes(spark: SparkSession, d: str) -> DataFrame:
    """Each product's price history as a note."""
    return _notes(spark, d)


@query("snk4_notes_read_back", f"WITH {_CHANGES} SELECT * FROM c")
def notes_read_back(spark: SparkSession, d: str) -> DataFrame:
    """The price changes, through their notes."""
    return notes.read(_notes(spark, d))
