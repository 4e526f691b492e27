"""Registered queries: more gates, joins, reports and picks, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlens.functions import fuzzy
from offerlens.functions import text as T
from offerlens.operators import grouping as G
from offerlens.operators import matching as M
from offerlens.operators import offers as O
from offerlens.plans.offer_queries import offers, query
from offerlens.session import table


def _count_if(**conditions):
    return [F.count_if(c).alias(k) for k, c in conditions.items()]


@query("flt3_availability_reading", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'R' THEN 'discontinued' ELSE 'unavailable' END WHEN l_shipdate > TIMESTAMP '1998-06-01' THEN 'not_yet' ELSE 'available' END AS availability FROM lineitem")
def availability_reading(spark: SparkSession, d: str) -> DataFrame:
    closed = F.when(F.col("l_returnflag") == "R", "discontinued").otherwise("unavailable")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", closed).when(F.col("l_shipdate") > F.lit("1998-06-01").cast("timestamp_ntz"), "not_yet").otherwise("available").alias("availability"))


@query("flt5_validity", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) + 90 < DATE '1997-01-01' THEN 'expired' WHEN CAST(o_orderdate AS DATE) > DATE '1997-01-01' THEN 'not_yet_valid' ELSE 'valid' END AS validity FROM orders")
def validity(spark: SparkSession, d: str) -> DataFrame:
    day, today = F.col("o_orderdate").cast("date"), F.to_date(F.lit("1997-01-01"))
    return table(spark, d, "orders").select("o_orderkey", F.when(F.date_add(day, 90) < today, "expired").when(day > today, "not_yet_valid").otherwise("valid").alias("validity"))


@query("flt8_confidence_ceiling", "SELECT s_suppkey, CASE WHEN n IS NULL THEN 'unknown' WHEN n >= 100 AND s_acctbal > 0 THEN 'strong' WHEN n >= 50 THEN 'limited' ELSE 'weak' END AS ceiling FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_suppkey = s_suppkey")
def confidence_ceiling(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    ceiling = F.when(F.col("n").isNull(), "unknown").when((F.col("n") >= 100) & (F.col("s_acctbal") > 0), "strong").when(F.col("n") >= 50, "limited").otherwise("weak")
    return table(spark, d, "supplier").join(n, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", ceiling.alias("ceiling"))


@query("flt11_locale_rates", "SELECT n_name AS market, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS ready, CAST(count(*) FILTER (c_acctbal > 0) * 1000 // count(*) AS BIGINT) AS rate, CASE WHEN count(*) FILTER (c_acctbal > 0) * 10 >= count(*) * 9 THEN 'eligible' ELSE 'review' END AS status FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def locale_rates(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), *_count_if(ready=F.col("c_acctbal") > 0))
    named = per.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("n_name").alias("market"), "n", "ready", F.floor(F.col("ready") * 1000 / F.col("n")).cast("bigint").alias("rate"), F.when(F.col("ready") * 10 >= F.col("n") * 9, "eligible").otherwise("review").alias("status"))


@query("flt13_batch_readiness", "SELECT l_suppkey AS shop, count(*) AS n, count(*) FILTER (l_discount > 0) AS with_sale, count(*) FILTER (l_returnflag <> 'R') AS kept, count(*) FILTER (l_discount > 0) * 100 >= 80 * count(*) AND count(*) FILTER (l_returnflag <> 'R') * 100 >= 60 * count(*) AS ready FROM lineitem GROUP BY l_suppkey")
def batch_readiness(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("shop")).agg(F.count("*").alias("n"), *_count_if(with_sale=F.col("l_discount") > 0, kept=F.col("l_returnflag") != "R"))
    return per.withColumn("ready", (F.col("with_sale") * 100 >= 80 * F.col("n")) & (F.col("kept") * 100 >= 60 * F.col("n")))


@query("flt15_index_gate", "SELECT doc_id, CAST(35 * (n_chars >= 500)::INT + 30 * (lang = 'en')::INT + 20 * (length(text) - length(replace(text, chr(10), '')) >= 3)::INT + 15 * (NOT contains(text, '!!'))::INT AS BIGINT) AS score FROM documents")
def index_gate(spark: SparkSession, d: str) -> DataFrame:
    part = lambda c, n: F.when(c, n).otherwise(0)
    score = part(F.col("n_chars") >= 500, 35) + part(F.col("lang") == "en", 30) + part(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) >= 3, 20) + part(~F.contains("text", F.lit("!!")), 15)
    return table(spark, d, "documents").select("doc_id", score.cast("bigint").alias("score"))


@query("flt17_promotion_states", "SELECT user_id, CASE WHEN n < 3 THEN 'observe' WHEN n_purchase = 0 THEN 'hold' WHEN n_purchase * 10 >= n THEN 'promote' ELSE 'review' END AS state FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_purchase FROM events GROUP BY user_id)")
def promotion_states(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), *_count_if(p=F.col("event_type") == "purchase"))
    return per.select("user_id", F.when(F.col("n") < 3, "observe").when(F.col("p") == 0, "hold").when(F.col("p") * 10 >= F.col("n"), "promote").otherwise("review").alias("state"))


@query("flt23_cluster_status", "SELECT source, count(*) AS n, count(*) FILTER (n_chars < 300) AS blocked, count(*) FILTER (n_chars BETWEEN 300 AND 1000) AS review, count(*) FILTER (n_chars > 1000) AS ready FROM documents GROUP BY source")
def cluster_status(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), *_count_if(blocked=n < 300, review=n.between(300, 1000), ready=n > 1000))


@query("flt24_whole_words", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])(this|these)([^a-z0-9]|$)')")
def whole_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.lower("text").rlike("(^|[^a-z0-9])(this|these)([^a-z0-9]|$)")).select("doc_id")


@query("flt26_gone_pages", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def gone_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("flt27_query_gates", "SELECT conv_id, turn, CASE WHEN length(trim(text)) < 3 THEN 'empty' WHEN length(text) > 2000 THEN 'too_long' WHEN regexp_matches(text, '[0-9]{9,}') THEN 'unsafe' ELSE 'fine' END AS gate FROM conversations")
def query_gates(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.length(F.trim(text)) < 3, "empty").when(F.length(text) > 2000, "too_long").when(text.rlike("[0-9]{9,}"), "unsafe").otherwise("fine").alias("gate"))


@query("jn10_duplicate_records", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey AND abs(CAST(round(a.c_acctbal * 100) AS BIGINT) - CAST(round(b.c_acctbal * 100) AS BIGINT)) <= 20000")
def duplicate_records(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one nation and segment whose balances are within 200."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("v"))
    return M.near_numbers(rows, "c_custkey", "v", ["c_nationkey", "c_mktsegment"], 20_000)


@query(
    "jn12_deletion_join",
    """WITH n AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS word FROM benchmark), q AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS word FROM conversations)
    SELECT q.word AS query_word, n.word AS known_word FROM q JOIN n ON abs(length(q.word) - length(n.word)) <= 1 AND levenshtein(q.word, n.word) <= 1""",
)
def deletion_join(spark: SparkSession, d: str) -> DataFrame:
    """Words of conversations within one edit of a benchmark word: both share a deletion, so the join is on equal deletions."""
    words = lambda name: table(spark, d, name).select(F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")).alias("word")).distinct()
    asked, known = words("conversations").withColumnRenamed("word", "query_word"), words("benchmark").withColumnRenamed("word", "known_word")
    a, b = asked.select("query_word", F.explode(T.deletions(F.col("query_word"))).alias("cut")), known.select("known_word", F.explode(T.deletions(F.col("known_word"))).alias("cut"))
    return a.join(b, "cut").select("query_word", "known_word").distinct().where(F.levenshtein("query_word", "known_word", 1) >= 0)


@query("jn14_kind_members", "SELECT p_partkey FROM part WHERE p_type = 'STANDARD' UNION SELECT p_partkey FROM part WHERE contains(lower(p_name), 'standard')")
def kind_members(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.where("p_type = 'STANDARD'").select("p_partkey").union(part.where(F.contains(F.lower("p_name"), F.lit("standard"))).select("p_partkey")).distinct()


@query("jn15_failing_rows", "SELECT c.conv_id, c.turn, d.doc_id FROM conversations c JOIN documents d ON c.conv_id = d.doc_id JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 0 OR l.toxic = 1")
def failing_rows(spark: SparkSession, d: str) -> DataFrame:
    failing = table(spark, d, "labels").where("quality = 0 OR toxic = 1").join(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id")
    return table(spark, d, "conversations").join(failing, F.col("conv_id") == F.col("doc_id")).select("conv_id", "turn", "doc_id")


@query("jn17_cluster_products", "SELECT market, p_partkey, place FROM (SELECT n_name AS market, p_partkey, row_number() OVER (PARTITION BY n_name ORDER BY p_partkey) AS place FROM nation JOIN part ON p_size = n_nationkey + 1) WHERE place <= 4")
def cluster_products(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "part").join(table(spark, d, "nation"), F.col("p_size") == F.col("n_nationkey") + 1)
    return O.top_k(joined.select(F.col("n_name").alias("market"), "p_partkey"), "market", 4, F.col("p_partkey")).select("market", "p_partkey", "place")


@query("jn21_graph_edges", "SELECT 'brand' AS kind, 'product:' || p_partkey AS source, 'brand:' || lower(p_brand) AS target FROM part UNION ALL SELECT 'family', 'product:' || p_partkey, 'family:' || lower(p_type) FROM part UNION ALL SELECT DISTINCT 'sold_by', 'product:' || l_partkey, 'shop:' || l_suppkey FROM lineitem")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    product = F.concat(F.lit("product:"), F.col("p_partkey").cast("string"))
    edge = lambda kind, column: F.struct(F.lit(kind).alias("kind"), product.alias("source"), F.concat(F.lit(f"{kind}:"), F.lower(column)).alias("target"))
    own = table(spark, d, "part").select(F.explode(F.array(edge("brand", "p_brand"), edge("family", "p_type"))).alias("e")).select("e.*")
    sold = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return own.unionByName(sold.select(F.lit("sold_by").alias("kind"), F.concat(F.lit("product:"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("shop:"), F.col("l_suppkey").cast("string")).alias("target")))


@query("jn27_unpublished", "SELECT DISTINCT o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey)")
def unpublished(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_custkey").distinct().join(table(spark, d, "events").select(F.col("user_id").alias("o_custkey")), "o_custkey", "left_anti")


@query("agg2_view_of_a_grouping", "WITH g AS (SELECT l_suppkey AS shop, count(*) AS n FROM lineitem GROUP BY ALL) SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS total, max(n) AS largest, count(*) FILTER (n * 100 > (SELECT sum(n) FROM g)) AS over_share, CAST(sum(least(n, 500)) AS BIGINT) AS kept FROM g")
def view_of_a_grouping(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).withColumn("t", F.sum("n").over(Window.partitionBy()))
    return groups.agg(F.count("*").alias("n_groups"), F.sum("n").alias("total"), F.max("n").alias("largest"), F.count_if(F.col("n") * 100 > F.col("t")).alias("over_share"), F.sum(F.least("n", F.lit(500))).alias("kept"))


@query("agg6_shared_by_part_only", "SELECT p_brand, p_type, count(*) AS n_products, count(DISTINCT p_size) AS n_sizes FROM part GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT p_size) > 1")
def shared_by_part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n_products"), F.count_distinct("p_size").alias("n_sizes")).where("n_products > 1 AND n_sizes > 1")


@query("agg26_latency_places", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (i = n // 2) AS middle, max(value) FILTER (i = n * 95 // 100) AS p95, count(*) AS n FROM r GROUP BY event_type")
def latency_places(spark: SparkSession, d: str) -> DataFrame:
    """Middle and 95th value by position. There are few event types with many rows each, so each value's place is found from
    counts of equal values, added up, not by numbering all rows in one task."""
    counts = table(spark, d, "events").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    by = Window.partitionBy("event_type")
    upto = counts.withColumns({"upto": F.sum("c").over(by.orderBy("value")), "n": F.sum("c").over(by)})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("value")))
    return upto.groupBy("event_type").agg(at(F.floor(F.col("n") / 2)).alias("middle"), at(F.floor(F.col("n") * 95 / 100)).alias("p95"), F.max("n").alias("n"))


@query("agg27_missing_fields", "SELECT count(*) AS n, count(*) FILTER (text IS NULL OR text = '') AS no_text, count(*) FILTER (lang IS NULL) AS no_lang, count(*) FILTER (source IS NULL) AS no_source, count(DISTINCT lang) AS n_langs FROM documents")
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count("*").alias("n"), *_count_if(no_text=F.col("text").isNull() | (F.col("text") == ""), no_lang=F.col("lang").isNull(), no_source=F.col("source").isNull()), F.count_distinct("lang").alias("n_langs"))


@query("agg29_decisions", "SELECT o_orderstatus AS status, o_orderpriority AS tier, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY ALL")
def decisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("tier")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("total"))


@query("agg31_collisions", "SELECT lower(p_name) AS name, count(*) AS entries, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY 1 HAVING count(*) > 1")
def collisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.lower("p_name").alias("name")).agg(F.count("*").alias("entries"), F.count_distinct("p_brand").alias("n_brands")).where("entries > 1")


@query("agg36_dominant_kinds", "WITH c AS (SELECT l_suppkey AS shop, p_type, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY shop) AS total, row_number() OVER (PARTITION BY shop ORDER BY n DESC, p_type) AS k FROM c) SELECT shop, p_type AS kind, n, n * 3 >= total * 2 AS dominant FROM t WHERE k = 1")
def dominant_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("shop"), "p_type").agg(F.count("*").alias("n"))
    total = kinds.withColumn("total", F.sum("n").over(Window.partitionBy("shop")))
    return O.top_k(total, "shop", 1, F.desc("n"), F.col("p_type")).select("shop", F.col("p_type").alias("kind"), "n", (F.col("n") * 3 >= F.col("total") * 2).alias("dominant"))


@query("agg43_transitions", "WITH s AS (SELECT o_custkey, o_orderpriority AS now, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) SELECT before, now, count(*) AS n FROM s WHERE before IS NOT NULL GROUP BY ALL")
def transitions(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select(before.alias("before"), F.col("o_orderpriority").alias("now")).where("before IS NOT NULL").groupBy("before", "now").agg(F.count("*").alias("n"))


@query("agg47_grouped_examples", "WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) SELECT source, lang, n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k) AS examples, CAST(least(95, 45 + 5 * n) AS BIGINT) AS confidence FROM r WHERE k <= 5 GROUP BY source, lang, n")
def grouped_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.concat_ws("|", "source", "lang").alias("g"), "source", "lang", "doc_id")
    n = rows.groupBy("g").agg(F.count("*").alias("n"))
    first = O.top_k(rows, "g", 5, F.col("doc_id")).groupBy("g", "source", "lang").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return first.join(n, "g").select("source", "lang", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("examples"), F.least(F.lit(95), 45 + 5 * F.col("n")).cast("bigint").alias("confidence"))


@query("win2_first_places", "WITH {OFFERS}, p AS (SELECT shop, price, row_number() OVER (PARTITION BY shop ORDER BY price, offer_id) AS k FROM offers) SELECT shop, price, min(k) AS first_place FROM p GROUP BY ALL")
def first_places(spark: SparkSession, d: str) -> DataFrame:
    """The first place of each price: the number of cheaper offers and one, from counts of equal prices."""
    counts = offers(spark, d).groupBy("shop", "price").agg(F.count("*").alias("n"))
    return counts.select("shop", "price", (F.sum("n").over(Window.partitionBy("shop").orderBy("price")) - F.col("n") + 1).alias("first_place"))


@query("win4_keep_first", "SELECT min(p_partkey) AS p_partkey, p_brand, lower(p_name) AS name FROM part GROUP BY p_brand, lower(p_name)")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand", F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("p_partkey"))


@query("win12_clipped_runs", "SELECT o_custkey, o_orderkey, greatest(CAST(o_orderdate AS DATE), DATE '1996-01-01') AS first_day, least(CAST(o_orderdate AS DATE) + 30, DATE '1996-12-31') AS last_day FROM orders WHERE CAST(o_orderdate AS DATE) + 30 >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1996-12-31'")
def clipped_runs(spark: SparkSession, d: str) -> DataFrame:
    first, last, day = F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("1996-12-31")), F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").where((F.date_add(day, 30) >= first) & (day <= last)).select("o_custkey", "o_orderkey", F.greatest(day, first).alias("first_day"), F.least(F.date_add(day, 30), last).alias("last_day"))


@query("win18_stratified", "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM part), s AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY least(k, 2), p_partkey) AS place FROM r) SELECT p_brand, p_partkey, place FROM s WHERE place <= 8")
def stratified(spark: SparkSession, d: str) -> DataFrame:
    """Of each brand eight products: the first of each type, then the rest in order."""
    k = F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey"))
    return O.top_k(table(spark, d, "part").withColumn("k", k), "p_brand", 8, F.least("k", F.lit(2)), F.col("p_partkey")).select("p_brand", "p_partkey", "place")


@query("srt5_pinned_first", "WITH {OFFERS}, b AS (SELECT shop, max(price) AS pin FROM offers GROUP BY shop), r AS (SELECT o.shop, offer_id, row_number() OVER (PARTITION BY o.shop ORDER BY CASE WHEN price = pin THEN 0 WHEN state = 'O' THEN 1 ELSE 2 END, price, offer_id) AS place FROM offers o JOIN b ON b.shop = o.shop) SELECT * FROM r WHERE place <= 8")
def pinned_first(spark: SparkSession, d: str) -> DataFrame:
    all_ = offers(spark, d)
    pins = all_.groupBy("shop").agg(F.max("price").alias("pin"))
    order = F.when(F.col("price") == F.col("pin"), 0).when(F.col("state") == "O", 1).otherwise(2)
    return O.top_k(all_.join(pins, "shop").withColumn("o", order), "shop", 8, F.col("o"), F.col("price"), F.col("offer_id")).select("shop", "offer_id", "place")


@query("srt9_best_of_slots", "WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_acctbal > 0) DESC, CAST(round(s_acctbal * 100) AS BIGINT) DESC, s_suppkey) AS place FROM supplier) SELECT * FROM r WHERE place <= 4")
def best_of_slots(spark: SparkSession, d: str) -> DataFrame:
    return O.top_k(table(spark, d, "supplier"), "s_nationkey", 4, F.desc(F.col("s_acctbal") > 0), F.desc(F.round(F.col("s_acctbal") * 100).cast("bigint")), F.col("s_suppkey")).select("s_nationkey", "s_suppkey", "place")


@query("set1_all_feeds", "SELECT 'part' AS feed, p_partkey AS id FROM part UNION ALL SELECT 'shop', s_suppkey FROM supplier UNION ALL SELECT 'customer', c_custkey FROM customer")
def all_feeds(spark: SparkSession, d: str) -> DataFrame:
    one = lambda feed, name, key: table(spark, d, name).select(F.lit(feed).alias("feed"), F.col(key).alias("id"))
    return one("part", "part", "p_partkey").unionByName(one("shop", "supplier", "s_suppkey")).unionByName(one("customer", "customer", "c_custkey"))


@query(
    "set7_tied_products",
    """WITH RECURSIVE t AS (SELECT p_partkey AS id, p_brand || '|' || p_name AS k FROM part UNION ALL SELECT p_partkey, p_type || '|' || p_size || '|' || p_brand FROM part), h AS (SELECT k FROM t GROUP BY k HAVING count(*) <= 40), e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM t a JOIN t b USING (k) JOIN h USING (k)),
    r(id, g) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id) SELECT id AS p_partkey, min(g) AS group_id FROM r GROUP BY id""",
)
def tied_products(spark: SparkSession, d: str) -> DataFrame:
    """Components of products with a common name, or type, size and brand; a tie with over 40 holders says nothing. A tie's holders point at its least one."""
    part = table(spark, d, "part")
    keys = F.array(F.concat_ws("|", F.lit("n"), "p_brand", "p_name"), F.concat_ws("|", F.lit("t"), "p_type", F.col("p_size").cast("string"), "p_brand"))
    held = part.select(F.col("p_partkey").alias("a"), F.explode(keys).alias("k"))
    least = held.groupBy("k").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n BETWEEN 2 AND 40")
    return G.groups(part.select(F.col("p_partkey").alias("node")), held.join(least, "k").select("a", "b")).select(F.col("node").alias("p_partkey"), F.col("group").alias("group_id"))


@query("fn1_plain_letters", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def plain_letters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fuzzy.plain_letters(F.col("text")).alias("text"))


@query(
    "fn6_swap_distances",
    """WITH n AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS word FROM benchmark)
    SELECT a.word AS a, b.word AS b, damerau_levenshtein(a.word, b.word) AS distance FROM n a JOIN n b ON a.word < b.word AND abs(length(a.word) - length(b.word)) <= 1 AND damerau_levenshtein(a.word, b.word) <= 1""",
)
def swap_distances(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark words that are one edit or one swap apart."""
    word = table(spark, d, "benchmark").select(F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")).alias("word")).distinct()
    return M.near_words(word, 1).withColumn("distance", fuzzy.near_distance(F.col("a"), F.col("b")).cast("bigint")).where("distance <= 1").select("a", "b", "distance")


@query("fn24_offer_scores", "WITH {OFFERS} SELECT offer_id, 40 * (state = 'O')::BIGINT + 30 * (flag <> 'R')::BIGINT + 20 * (sale_price < price)::BIGINT + least(quantity, 10) AS score FROM offers")
def offer_scores(spark: SparkSession, d: str) -> DataFrame:
    part = lambda c, n: F.when(c, n).otherwise(0)
    score = part(F.col("state") == "O", 40) + part(F.col("flag") != "R", 30) + part(F.col("sale_price") < F.col("price"), 20) + F.least("quantity", F.lit(10))
    return offers(spark, d).select("offer_id", score.cast("bigint").alias("score"))


@query("str6_expired_state", "SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def expired_state(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    newest = last.agg(F.max("last_ts").alias("newest"))
    return last.crossJoin(F.broadcast(newest)).where("last_ts >= newest - INTERVAL 7 DAYS").select("user_id", "last_ts")


@query("str11_chunks", "SELECT event_type, chunk, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT *, (row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) - 1) // 25 AS chunk FROM events) GROUP BY ALL")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("event_type", F.col("ts").cast("date")).orderBy("event_id"))
    return table(spark, d, "events").withColumn("chunk", F.floor((place - 1) / 25).cast("bigint")).groupBy("event_type", "chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("str13_due_states", "SELECT c_custkey, CASE WHEN last IS NULL THEN 'never' WHEN last < DATE '1997-08-02' THEN 'due' WHEN last < DATE '1998-02-02' THEN 'soon' ELSE 'fresh' END AS due FROM customer LEFT JOIN (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def due_states(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.col("o_orderdate").cast("date")).alias("last"))
    at = lambda day: F.col("last") < F.to_date(F.lit(day))
    return table(spark, d, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.when(F.col("last").isNull(), "never").when(at("1997-08-02"), "due").when(at("1998-02-02"), "soon").otherwise("fresh").alias("due"))
