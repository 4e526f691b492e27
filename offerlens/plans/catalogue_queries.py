"""Registered queries on the catalogue: quotas, freshness, stock, titles and labels, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlens.functions import price as P
from offerlens.functions import text as T
from offerlens.operators import offers as O
from offerlens.plans.offer_queries import offers, query
from offerlens.session import spread, table

#: The day on which the catalogue is read; later nights count as no days old.
TODAY = "1998-12-01"


@query(
    "agg4_fair_quotas",
    """WITH g AS (SELECT coalesce(lang, '') || '/' || coalesce(source, '') AS name, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) // 2 AS places FROM g),
    e AS (SELECT max(level) AS equal FROM (SELECT unnest(range(0, (SELECT max(n) + 1 FROM g))) AS level) WHERE (SELECT sum(least(n, level)) FROM g) <= (SELECT places FROM t)),
    x AS (SELECT name, n, equal, places - sum(least(n, equal)) OVER () AS extra, row_number() OVER (ORDER BY (n > equal) DESC, n DESC, name) AS k FROM g, e, t)
    SELECT name, n, CAST(least(n, equal) + CASE WHEN n > equal AND k <= extra THEN 1 ELSE 0 END AS BIGINT) AS quota FROM x""",
)
def fair_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Half of the documents, shared fairly by the groups of language and source."""
    name = F.concat_ws("/", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))
    groups = table(spark, d, "documents").groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return O.fair_quotas(groups, 50)


@query(
    "agg10_feed_freshness",
    f"""WITH o AS (SELECT l_suppkey AS shop, greatest(0, DATE '{TODAY}' - CAST(l_shipdate AS DATE)) AS age, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
    SELECT shop, count(*) AS products, count(age) AS dated, median(age) AS median_age_days, {', '.join(f'count(*) FILTER (age > {n}) AS older_than_{n}' for n in O.AGES)}, count(*) FILTER (q <= 0) AS quantity_zero, count(*) FILTER (q > 0) AS quantity_positive FROM o GROUP BY shop""",
)
def feed_freshness(spark: SparkSession, d: str) -> DataFrame:
    return O.freshness(offers(spark, d), "shop", TODAY)


@query(
    "agg38_majority_zone",
    """WITH l AS (SELECT l_orderkey AS answer, n_regionkey AS zone, l_linenumber AS place FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
    c AS (SELECT answer, zone, count(*) AS n, min(place) AS first_place FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY n DESC, first_place, zone) AS k, sum(n) OVER (PARTITION BY answer) AS total FROM c)
    SELECT answer, zone, n AS kept, CAST(total - n AS BIGINT) AS dropped FROM r WHERE k = 1""",
)
def majority_zone(spark: SparkSession, d: str) -> DataFrame:
    """The price zone that most rows of an order share (the one seen first wins a tie), and how many rows leave with the others."""
    zones = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("zone"))
    rows = table(spark, d, "lineitem").join(zones, F.col("l_suppkey") == F.col("s_suppkey"))
    return O.majority(rows.select(F.col("l_orderkey").alias("answer"), "zone", F.col("l_linenumber").alias("place")), "answer", "zone", "place")


@query(
    "prj4_currency_split",
    r"""WITH {OFFERS}, t AS (SELECT offer_id, CASE price % 3 WHEN 0 THEN s || ' GBP' WHEN 1 THEN 'GBP ' || s ELSE s END AS t FROM (SELECT offer_id, price, price // 100 || '.' || lpad(CAST(price % 100 AS VARCHAR), 2, '0') AS s FROM offers))
    SELECT offer_id, CASE WHEN regexp_matches(t, '^[A-Z]{3}\s+\S+$') THEN regexp_extract(t, '\S+$') WHEN regexp_matches(t, '^\S+\s+[A-Z]{3}$') THEN regexp_extract(t, '^\S+') ELSE t END AS amount, regexp_extract(t, '[A-Z]{3}') AS code FROM t""",
)
def currency_split(spark: SparkSession, d: str) -> DataFrame:
    number = F.concat_ws(".", F.floor(F.col("price") / 100).cast("string"), F.lpad((F.col("price") % 100).cast("string"), 2, "0"))
    text = F.when(F.col("price") % 3 == 0, F.concat(number, F.lit(" GBP"))).when(F.col("price") % 3 == 1, F.concat(F.lit("GBP "), number)).otherwise(number)
    return offers(spark, d).select("offer_id", P.amount_and_code(text).alias("s")).select("offer_id", "s.amount", "s.code")


@query(
    "jn7_stock_override",
    f"""WITH {{OFFERS}}, c AS (SELECT shop, product, max(night) AS seen, arg_max(in_stock, night) AS in_stock FROM (SELECT shop, product, night, max(quantity) > 25 AS in_stock FROM offers WHERE night <= DATE '{TODAY}' GROUP BY ALL) GROUP BY ALL)
    SELECT offer_id, seen, CASE WHEN DATE '{TODAY}' - seen <= 3 THEN CASE WHEN in_stock THEN 'in_stock' ELSE 'sold_out' END WHEN state = 'O' THEN 'in_stock' ELSE 'sold_out' END AS stock, coalesce(DATE '{TODAY}' - seen <= 3, FALSE) AS overridden FROM offers LEFT JOIN c USING (shop, product)""",
)
def stock_override(spark: SparkSession, d: str) -> DataFrame:
    """What a shop's own catalogue says about stock goes before the feed's word, if it was seen in the last three days."""
    rows = offers(spark, d)
    nights = rows.where(F.col("night") <= F.to_date(F.lit(TODAY))).groupBy("shop", "product", "night").agg((F.max("quantity") > 25).alias("in_stock"))
    catalogue = nights.groupBy("shop", "product").agg(F.max("night").alias("seen"), F.max_by("in_stock", "night").alias("in_stock"))
    feed = rows.withColumn("stock", F.when(F.col("state") == "O", "in_stock").otherwise("sold_out"))
    return O.stock_of_catalogue(feed, catalogue, ["shop", "product"], TODAY, 3).select("offer_id", "seen", "stock", "overridden")


@query(
    "fn11_misspellings",
    """WITH w AS (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS w FROM part), k AS (SELECT *, list_position(list_transform(w, lambda x: length(x)), list_max(list_transform(w, lambda x: length(x)))) AS k FROM w),
    s AS (SELECT *, w[k] AS x, length(w[k]) AS n, greatest(1, length(w[k]) // 2 - 1) AS p, length(w[k]) // 2 AS h, array_to_string(w[:k-1], ' ') || CASE WHEN k > 1 THEN ' ' ELSE '' END AS before, CASE WHEN k < len(w) THEN ' ' ELSE '' END || array_to_string(w[k+1:], ' ') AS after FROM k)
    SELECT p_partkey, CASE WHEN n >= 5 THEN before || left(x, h) || substr(x, h + 2) || after ELSE '' END AS missing,
        CASE WHEN n >= 4 AND x[p+1] <> x[p+2] THEN before || left(x, p) || x[p+2] || x[p+1] || substr(x, p + 3) || after ELSE '' END AS swapped,
        CASE WHEN n >= 4 THEN before || left(x, h) || x[h+1] || substr(x, h + 1) || after ELSE '' END AS doubled, CASE WHEN len(w) >= 2 THEN array_to_string(w, '') ELSE '' END AS joined FROM s""",
)
def misspellings(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", T.misspellings(F.col("p_name")).alias("m")).select("p_partkey", "m.*")


@query(
    "set5_title_closeness",
    """WITH t AS (SELECT p_partkey, p_brand, list_distinct(string_split(lower(p_name || ' ' || p_type || ' ' || p_size), ' ')) AS w FROM part),
    x AS (SELECT p_partkey, lag(p_partkey) OVER b AS before, w, lag(w) OVER b AS v FROM t WINDOW b AS (PARTITION BY p_brand ORDER BY p_partkey)),
    y AS (SELECT *, len(list_intersect(w, v)) AS shared, greatest(len(w), len(v)) - len(list_intersect(w, v)) AS apart FROM x WHERE before IS NOT NULL)
    SELECT p_partkey, before, apart, apart <= 3 AND shared > apart AS close FROM y""",
)
def title_closeness(spark: SparkSession, d: str) -> DataFrame:
    """Each product's title beside the one before it of the same brand."""
    by = Window.partitionBy("p_brand").orderBy("p_partkey")
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))), " "))
    pairs = table(spark, d, "part").select("p_partkey", "p_brand", words.alias("w")).withColumns({"before": F.lag("p_partkey").over(by), "v": F.lag("w").over(by)}).where("before IS NOT NULL")
    return pairs.select("p_partkey", "before", T.words_apart(F.col("w"), F.col("v")).cast("bigint").alias("apart"), T.words_close(F.col("w"), F.col("v"), 3).alias("close"))


@query(
    "win3_role_labels",
    """WITH {OFFERS}, f AS (SELECT * FROM (SELECT offer_id, product, price, row_number() OVER (PARTITION BY product ORDER BY price, offer_id) AS place FROM offers) WHERE place <= 6),
    r AS (SELECT *, rank() OVER (PARTITION BY product ORDER BY price) AS rank, count(*) OVER (PARTITION BY product) AS n FROM f), s AS (SELECT *, CASE WHEN n = 4 THEN 'these four' ELSE 'these ' || n END AS scope FROM r)
    SELECT offer_id, product, CASE WHEN n <= 1 THEN 'Only option with a comparable price' WHEN rank = 1 THEN 'Lowest price of ' || scope WHEN rank >= n THEN 'Highest price of ' || scope
        WHEN rank <= 5 THEN CASE rank WHEN 2 THEN '2nd' WHEN 3 THEN '3rd' ELSE rank || 'th' END || ' lowest price of ' || scope ELSE 'Price rank ' || rank || ' of ' || scope END AS label FROM s""",
)
def role_labels(spark: SparkSession, d: str) -> DataFrame:
    """The six cheapest offers of each product, and what their labels say."""
    return O.role_labels(O.top_k(offers(spark, d), "product", 6, F.col("price"), F.col("offer_id")), "product").select("offer_id", "product", "label")


@query(
    "prj33_address_shelves",
    r"""WITH p AS (SELECT page_id, list_filter(string_split(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda x: x <> '') AS s FROM pages)
    SELECT page_id, coalesce(array_to_string(list_filter(list_transform(s[:-2], lambda x: trim(regexp_replace(x, '[-_+]+', ' ', 'g'))), lambda x: x <> ''), ' > '), '') AS shelves FROM p""",
)
def address_shelves(spark: SparkSession, d: str) -> DataFrame:
    """The shelves that an address names before its product."""
    return table(spark, d, "pages").select("page_id", T.shelves(F.col("url")).alias("shelves"))


@query("srt2_cheapest_offers", "WITH {OFFERS} SELECT offer_id, product, price FROM offers ORDER BY price, offer_id LIMIT 50")
def cheapest_offers(spark: SparkSession, d: str) -> DataFrame:
    """The fifty cheapest offers of all: each task keeps fifty, no total sort."""
    return offers(spark, d).select("offer_id", "product", "price").orderBy("price", "offer_id").limit(50)
